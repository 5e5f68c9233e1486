"""Vector search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import vectors
from cliploom.storage import fresh_folder

SCHEMA = "vec_id long, embedding array<float>, cell int, unit string"


def truth(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scores = unit[queries] @ unit.T
    scores[np.arange(len(queries)), queries] = -2
    return {int(q): np.argsort(-s, kind="stable")[:k].tolist() for q, s in zip(queries, scores, strict=True)}


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist(), 1, "u") for k, v in enumerate(x)], SCHEMA).repartition(4)


def found(spark, df, k, **more):
    path = fresh_folder(spark, "vectors")
    vectors.write_index(df, path, **more)
    index = vectors.read_index(spark, path, k)
    queries = vectors.usable(df).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    rows = index.search(queries, k).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return index, got, rows


@pytest.mark.parametrize("shape", ["even", "clusters", "one cluster"])
def test_recall_against_all_pairs(spark, monkeypatch, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 48))
    if shape == "clusters":
        x += 4 * rng.normal(size=(30, 48))[rng.integers(0, 30, 1500)]
    if shape == "one cluster":  # a third of all rows, in shards and groups
        x[:500] = 0.3 * x[:500] + rng.normal(size=48)
        monkeypatch.setattr(vectors, "SHARD", 40)
        monkeypatch.setattr(vectors, "GROUP", 3)
    index, got, rows = found(spark, frame(spark, x), 10, sample=800)
    want = truth(x, np.arange(0, 1500, 20), 10)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(got[q]) == 10 for q in want)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert max(abs(r.cosine - unit[r.query_id] @ unit[r.vec_id]) for r in rows) < 1e-6
    if shape == "clusters":
        assert index.probe <= len(index.books.centres) // 2  # most cells are left out
    assert index.codes.count() == 1500


def test_vectors_without_direction_are_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (20, [0.0, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, got, _ = found(spark, df, 2)
    assert got == {0: [1, 20], 20: [1, 0]}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert found(spark, none, 3)[1] == {}
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert found(spark, one, 3)[1] == {}


def test_codebooks_survive_storage(spark):
    books = vectors.Codebooks(np.arange(12.0).reshape(3, 4), [np.ones((2, 2)), np.zeros((5, 2))])
    path = fresh_folder(spark, "books")
    vectors.write_books(books, spark, path)
    again = vectors.read_books(spark, path)
    assert np.array_equal(again.centres, books.centres) and all(np.array_equal(a, b) for a, b in zip(again.words, books.words, strict=True))


def test_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(vectors.unit(F.col("v")).alias("u"))
    assert [round(x, 6) for x in df.first().u] == [0.6, 0.8]


def shuffled(spark, df):
    """MB that writing df shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_codes_worth_keeping_are_not_shuffled(spark):
    rng = np.random.default_rng(5)
    df, path = frame(spark, rng.normal(size=(4000, 32))), fresh_folder(spark, "vectors")
    vectors.write_index(df, path)
    index = vectors.read_index(spark, path, 5)
    queries = vectors.usable(df).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index.keep = 20
    few = shuffled(spark, index.search(queries, 5))
    index.keep = 1000
    assert shuffled(spark, index.search(queries, 5)) < 1.2 * few


def test_equal_vectors_come_by_id(spark):
    x = np.random.default_rng(6).normal(size=(700, 16))
    x[100:] = x[100]  # far more copies than codes are kept
    _, got, _ = found(spark, frame(spark, x), 4)
    assert all(got[q] == [v for v in range(100, 106) if v != q][:4] for q in range(100, 700, 20))


def test_layout_of_cells(monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 10)
    first, shards = vectors.layout({0: 100, 2: 6, 3: 4, 4: 1, 5: 300}, 6)
    assert shards.tolist() == [10, 0, 1, 1, 1, 30] and first.tolist() == [0, 0, 10, 10, 11, 12]
