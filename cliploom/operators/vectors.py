"""Vector search by cosine over a stored index: k-means cells, product-quantized codes, exact re-ranking.

Codebooks are fitted on a bounded sample; every row is indexed. A unit vector is kept as its cell and, for each of PARTS
pieces of what is left of it beyond the cell's centre, the nearest of up to 256 codewords. A search looks into the cells
nearest to a query, scores codes by sums from a table of the query's products with all codewords (the query itself is not
coded), and compares the best exactly, in double precision. How many cells it looks into and how many codes it keeps are
measured, not guessed: CALIBRATION queries are compared with all rows, and the figures are those that find ENOUGH of their
true neighbours.

Cells are put together in shards, large ones are cut, and queries go in groups, so that no task holds more than about SHARD
vectors and GROUP queries. A query is sent once to each shard that holds cells it probes. Vectors lie beside their codes, so
a task compares its best codes exactly where they are and passes on k rows of a query, not all codes worth keeping; the codes
kept are those of each shard, no fewer than the best over all. The index is two Parquet tables: codebooks, and codes with
their vectors, whose files are ordered by cell.

Vectors that are null or zero, of another length than most of the sample, or that hold nulls or numbers that are not finite
are not indexed and find nothing. Rows without an id are ignored. Repeated ids count as vectors of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_importable
from ..storage import discard, stored

#: Rows of the sample that codebooks are fitted on; most cells; pieces of a vector; codewords of a piece; rounds of k-means.
SAMPLE, CELLS, PARTS, WORDS, ROUNDS = 16_384, 1024, 16, 256, 12
#: Queries compared with all rows; share of their neighbours that cells and kept codes must each reach; most codes kept.
CALIBRATION, ENOUGH, KEEP = 64, 0.98, 1000
#: Vectors, and queries, of a task, and numbers of either; shards that fewer vectors are dealt to.
SHARD, GROUP, NUMBERS, SPREAD = 1 << 15, 1 << 15, 1 << 22, 32
#: Cells of a matrix of scores made at once.
BLOCK = 1 << 22


def unit(vector: F.Column) -> F.Column:
    """The vector as doubles of length 1, or null where it has no direction."""
    double = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x))
    fit = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (norm > 0) & (norm < float("inf"))
    return F.when(fit, F.transform(double, lambda x: x / norm))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first; equal ones by number."""
    out, half = np.zeros((len(x), n), np.int32), (centres * centres).sum(1) / 2
    step = max(1, BLOCK // len(centres))
    for at in range(0, len(x), step):
        far = half - x[at : at + step] @ centres.T
        out[at : at + step] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random rows; a centre that loses all rows moves to the row farthest from its own."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (empty := np.flatnonzero(n == 0)).size:
            far = ((x - centres[own]) ** 2).sum(1)
            centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


@dataclass
class Codebooks:
    """Centres of the cells, and the codewords of each piece; a few MB at most, as CELLS and WORDS bound them."""

    centres: np.ndarray
    words: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def pieces(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = _nearest(x, self.centres)[:, 0]
        codes = [_nearest(part, words)[:, 0] for part, words in zip(self.pieces(x - self.centres[cells]), self.words, strict=True)]
        return cells, np.stack(codes, 1).astype(np.uint8)

    def products(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of queries with all codewords of each piece."""
        return [part @ words.T for part, words in zip(self.pieces(q), self.words, strict=True)]

    def scores(self, q: np.ndarray, products: list[np.ndarray], cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with coded vectors of one cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for k, table in enumerate(products):
            out += table[:, codes[:, k]]
        return out


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, cells: int = CELLS, parts: int = PARTS, seed: int = 1) -> Codebooks:
    """Codebooks of unit vectors (vec_id, unit), of which there are n: about the square root of n cells, from `sample` rows at most."""
    every = max(1, math.ceil(n / sample))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("unit").limit(sample).toArrow()["unit"].to_pylist()
    dim = Counter(map(len, rows)).most_common(1)[0][0]
    x = np.array([r for r in rows if len(r) == dim])
    rng = np.random.default_rng(seed)
    centres = k_means(x, min(cells, len(x), max(1, round(math.sqrt(n)))), ROUNDS, rng)
    left = x - centres[_nearest(x, centres)[:, 0]]
    words = [k_means(part, min(WORDS, len(part)), ROUNDS, rng) for part in np.array_split(left, min(parts, dim), axis=1)]
    return Codebooks(centres, words)


def _encoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            cells, codes = books.encode(_matrix(batch.column(1), books.dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["vec_id", "cell", "code", "unit"])

    return run


def layout(sizes: dict[int, int], cells: int, dim: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell (0: empty): neighbouring cells share one, those too large for one are cut."""
    most = max(1, min(SHARD, NUMBERS // dim, math.ceil(sum(sizes.values()) / SPREAD)))
    first, shards, at, room = np.zeros(cells, np.int32), np.zeros(cells, np.int32), -1, 0
    for cell, n in sorted(sizes.items()):
        if n > room:
            at, room = at + 1, most
        first[cell], shards[cell] = at, math.ceil(n / most)
        at, room = at + int(shards[cell]) - 1, room - n if n <= most else 0
    return first, shards


def _probed(sent, probe: int):
    """A row for each query and shard, with the cells there that the query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (first, shards) = sent.value
        for batch in batches:
            cells = _nearest(_matrix(batch.column(1), books.dim), books.centres, min(probe, len(books.centres)))
            rows, n = np.repeat(np.arange(len(cells)), cells.shape[1]), shards[cells.ravel()]
            rows, cell = np.repeat(rows, n), np.repeat(cells.ravel(), n)
            shard = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((cell, shard, rows))
            rows, shard, cell = rows[order], shard[order], cell[order]
            new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (shard[1:] != shard[:-1])))) if len(rows) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)), pa.int32()), pa.array(cell, pa.int32()))
            for at in range(0, len(new), 1 << 12):
                to = slice(at, at + (1 << 12))
                own = pa.array(rows[new[to]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), lists[to], pa.array(shard[new[to]], pa.int32())], ["query_id", "unit", "cells", "shard"])

    return run


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` greatest scores of each row, in no order; of equal ones the first columns."""
    if keep >= scores.shape[1]:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    chosen = np.take_along_axis(scores, best, 1)
    least = chosen.min(1)
    for row in np.flatnonzero((scores == least[:, None]).sum(1) > (chosen == least[:, None]).sum(1)):
        more = np.flatnonzero(scores[row] > least[row])
        best[row] = np.append(more, np.flatnonzero(scores[row] == least[row])[: keep - len(more)])
    return best


def _scored(sent, keep: int, k: int | None):
    """The `keep` best codes of a shard for each query; with k the k best of these by exact comparison."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if q.num_rows and c.num_rows:
            books, _ = sent.value
            ids, own = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
            cells = c["cell"].to_numpy()
            order = np.lexsort((ids, cells))
            ids, cells = ids[order], cells[order]
            codes = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            held, begins = np.unique(cells, return_index=True)
            ends = np.append(begins[1:], len(ids))
            by_id = np.argsort(ids, kind="stable")
            place = np.empty_like(by_id)
            place[by_id] = np.arange(len(by_id))
            vectors = _matrix(q["unit"].combine_chunks(), books.dim)
            columns = np.ascontiguousarray(_matrix(c["unit"].combine_chunks(), books.dim)[order].T) if k else None
            lists = q["cells"].combine_chunks()
            probes = np.zeros((len(own), len(held)), bool)
            wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            here = held[at] == wanted  # a piece of a large cell may have got no rows
            probes[of[here], at[here]] = True
            step = max(1, BLOCK // max(len(ids), keep))
            for at in range(0, len(own), step):
                some, mine = vectors[at : at + step], own[at : at + step]
                products, scores = books.products(some), np.full((len(mine), len(ids)), -np.inf)
                for n, cell in enumerate(held):
                    rows = np.flatnonzero(probes[at : at + step, n])
                    if len(rows):
                        scores[rows, begins[n] : ends[n]] = books.scores(some[rows], [t[rows] for t in products], int(cell), codes[begins[n] : ends[n]])
                scores[mine[:, None] == ids[None, :]] = -np.inf
                best = by_id[np.sort(place[_best(scores, keep)], axis=1)]
                worth = np.take_along_axis(scores, best, 1)
                if k:
                    exact = np.zeros(best.shape)
                    for d in range(books.dim):  # number by number, so that equal vectors have equal cosines
                        exact += columns[d][best] * some[:, d : d + 1]
                    worth = np.where(worth > -np.inf, exact, -np.inf)
                    top = np.argsort(-worth, axis=1, kind="stable")[:, :k]
                    best, worth = np.take_along_axis(best, top, 1), np.take_along_axis(worth, top, 1)
                row, column = np.nonzero(worth > -np.inf)
                for to, v in zip(found, (mine[row], ids[best[row, column]], worth[row, column]), strict=True):
                    to.append(v)
        kinds = (q.schema.field("query_id").type, c.schema.field("vec_id").type, pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _exact(sent, k: int):
    """The k best of each batch for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        for batch in batches:
            own, scores = batch.column(0).to_numpy(), queries @ _matrix(batch.column(1), queries.shape[1]).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            best = _best(scores, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], ["query_id", "vec_id", "score"])

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k greatest scores of each query, ranked; equal ones by vec_id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass
class Index:
    """A written index and how widely to search it."""

    codes: DataFrame
    vectors: DataFrame
    books: Codebooks
    probe: int
    keep: int

    def _found(self, queries: DataFrame, probe: int, keep: int, k: int | None) -> DataFrame:
        """(query_id, vec_id, score): what each shard finds for queries (query_id, unit)."""
        spark = queries.sparkSession
        queries = queries.where(F.size("unit") == self.books.dim)
        sizes = {r["cell"]: r["count"] for r in self.codes.groupBy("cell").count().collect()}  # CELLS rows at most
        first, shards = layout(sizes, len(self.books.centres), self.books.dim)
        sent, groups = spark.sparkContext.broadcast((self.books, (first, shards))), max(1, math.ceil(queries.count() / max(1, min(GROUP, NUMBERS // self.books.dim))))
        kind = queries.schema["query_id"].dataType.simpleString()
        left = queries.select("query_id", "unit").mapInArrow(_probed(sent, probe), f"query_id {kind}, unit array<double>, cells array<int>, shard int")
        left = left.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        cells = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(shards[c])) for c in sizes], "cell int, first int, shards int"))
        shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards").cast("long"))).cast("int")
        right = self.codes.join(cells, "cell").select("vec_id", "cell", "code", *(["unit"] if k else []), shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        keys = ("shard", "group")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored(sent, keep, k), f"query_id {kind}, vec_id {kind}, score double")

    def candidates(self, queries: DataFrame, probe: int, keep: int) -> DataFrame:
        """(query_id, vec_id, score, rank): the `keep` best codes of the `probe` nearest cells for queries (query_id, unit)."""
        return _top(self._found(queries, probe, keep, None), keep)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, cosine): the k nearest of queries (query_id, unit) among all others, compared exactly once found."""
        rows = _top(self._found(queries, self.probe, max(self.keep, k), k), k)
        return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("score").alias("cosine"))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, unit) of rows (vec_id, embedding) that can be compared."""
    return rows.where("vec_id is not null").select("vec_id", unit(F.col("embedding")).alias("unit")).where("unit is not null")


def write_books(books: Codebooks, spark: SparkSession, path: str) -> None:
    rows = [("cell", 0, k, v.tolist()) for k, v in enumerate(books.centres)] + [("word", p, k, v.tolist()) for p, words in enumerate(books.words) for k, v in enumerate(words)]
    spark.createDataFrame(rows, "kind string, part int, k int, v array<double>").write.parquet(f"{path}/codebooks")


def read_books(spark: SparkSession, path: str) -> Codebooks:
    rows = sorted(spark.read.parquet(f"{path}/codebooks").collect(), key=lambda r: (r.kind, r.part, r.k))
    parts = sorted({r.part for r in rows if r.kind == "word"})
    return Codebooks(np.array([r.v for r in rows if r.kind == "cell"]), [np.array([r.v for r in rows if r.kind == "word" and r.part == p]) for p in parts])


def write_index(rows: DataFrame, path: str, sample: int = SAMPLE) -> None:
    """Index all usable rows (vec_id, embedding) under path: codebooks, codes and unit vectors in files ordered by cell."""
    spark = rows.sparkSession
    ensure_importable(spark)
    units = stored(usable(rows), "units")
    n = units.count()
    if not n:
        write_books(Codebooks(np.zeros((1, 1)), [np.zeros((1, 1))]), spark, path)
        units.select("vec_id", F.lit(0).alias("cell"), F.lit(b"").alias("code"), "unit").write.parquet(f"{path}/codes")
        return
    books = fit(units, n, sample)
    write_books(books, spark, path)
    sent, kind = spark.sparkContext.broadcast(books), units.schema["vec_id"].dataType.simpleString()
    codes = units.where(F.size("unit") == books.dim).mapInArrow(_encoded(sent), f"vec_id {kind}, cell int, code binary, unit array<double>")
    codes.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.parquet(f"{path}/codes")  # not by ranges: that encodes twice
    discard(units)


def read_index(spark: SparkSession, path: str, k: int, calibration: int = CALIBRATION, enough: float = ENOUGH) -> Index:
    """The index under path, set to find `enough` of the k nearest by its cells and by the codes it keeps.

    `calibration` vectors, by least hash, are compared with all rows: the cells of their true neighbours, in the order in
    which a query probes them, tell how many cells are enough, the places of these neighbours among the codes how many of those.
    """
    ensure_importable(spark)
    books = read_books(spark, path)
    codes = spark.read.parquet(f"{path}/codes")
    index = Index(codes, codes.select("vec_id", "unit"), books, len(books.centres), k)
    some = index.vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).toPandas()
    if len(some) < 2:
        return index
    ids, queries = some["vec_id"].to_numpy(), np.stack(some["unit"].to_list())
    kind = index.vectors.schema["vec_id"].dataType.simpleString()
    rows = index.vectors.mapInArrow(_exact(spark.sparkContext.broadcast((ids, queries)), k), f"query_id {kind}, vec_id {kind}, score double").where("score >= -1.5")
    true = stored(_top(rows, k).join(index.codes.select("vec_id", "cell"), "vec_id"), "calibration")
    order = np.argsort(_nearest(queries, books.centres, len(books.centres)), axis=1)
    at = {q: k for k, q in enumerate(ids.tolist())}
    needed = sorted(int(order[at[r.query_id], r.cell]) + 1 for r in true.select("query_id", "cell").collect())  # calibration * k rows
    index.probe = needed[min(len(needed) - 1, math.ceil(enough * len(needed)) - 1)]
    sample = spark.createDataFrame([(int(i), q.tolist()) for i, q in zip(ids, queries, strict=True)], f"query_id {kind}, unit array<double>")
    places = index.candidates(sample, index.probe, max(KEEP, 20 * k)).select("query_id", "vec_id", F.col("rank").alias("place"))
    found = sorted(r.place for r in true.join(places, ["query_id", "vec_id"]).select("place").collect())
    index.keep = max(k, found[min(len(found) - 1, math.ceil(enough * len(found)) - 1)])
    discard(true)
    return index
