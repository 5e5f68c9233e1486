"""Numbers, running sums and ranks over whole tables against pandas and DuckDB."""

import random

import duckdb
import pytest

from cliploom.operators import ranking


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(k, 7 if k % 3 == 0 else rng.randrange(40) if k % 11 else None, rng.randrange(9) if k % 5 else None) for k in range(700)]
    return data, spark.createDataFrame(data, "id long, v long, amount long").repartition(5)


def test_numbered_counts_across_ranges(rows):
    data, df = rows
    got = {r.id: r.number for r in ranking.numbered(df, ["v", "id"]).collect()}
    want = {x[0]: k for k, x in enumerate(sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0])))}
    assert got == want


def test_running_sums_across_ranges(rows):
    data, df = rows
    got = {r.id: r.before for r in ranking.running(df, ["id"], "amount").collect()}
    total = 0
    for k, _, x in data:
        assert got[k] == total
        total += x or 0


@pytest.mark.parametrize(("descending", "buckets"), [(False, 4), (True, 9), (False, 900)])
def test_ranks(rows, descending, buckets):
    data, df = rows
    order = "v DESC NULLS LAST" if descending else "v ASC NULLS FIRST"
    c = duckdb.connect()
    c.execute("CREATE TABLE t(id BIGINT, v BIGINT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [x[:2] for x in data])
    want = c.execute(f"SELECT id, row_number() OVER (ORDER BY {order}, id), rank() OVER w, dense_rank() OVER w, percent_rank() OVER w, cume_dist() OVER w, ntile({buckets}) OVER (ORDER BY {order}, id) FROM t WINDOW w AS (ORDER BY {order}) ORDER BY id").fetchall()
    got = ranking.ranks(df, "v", ["id"], buckets, descending).orderBy("id").collect()
    assert [(r.id, r.number, r.rank, r.dense_rank, round(r.percent_rank, 12), round(r.cume_dist, 12), r.ntile) for r in got] == [(*x[:4], round(x[4], 12), round(x[5], 12), x[6]) for x in want]


def test_empty_and_one_row(spark):
    none = spark.createDataFrame([], "id long, v long")
    assert ranking.ranks(none, "v", ["id"]).collect() == []
    one = ranking.ranks(spark.createDataFrame([(1, None)], "id long, v long"), "v", ["id"]).first()
    assert (one.number, one.rank, one.percent_rank, one.cume_dist, one.ntile) == (1, 1, 0.0, 1.0, 1)
