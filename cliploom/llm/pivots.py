"""Embedding near-duplicates by a pivot-permutation index.

Pivots are reference points: vectors of a bounded sample, no two of them alike (among several pivots in one dense group the
order would be noise), filled up with random directions. Each vector is described by its nearest pivots in order. The index
is inverted: a list holds, within each label, the vectors that have the same `shared` pivots among their `near` nearest. Two
vectors are candidates if they share at least so many; every candidate pair is met in several lists, and is taken in the
one of the least pivots that it shares, so the shared pivots are counted before any cosine and no pair is compared twice.
Candidates are verified by the cosine in double precision. Pivots grow with the square root of the largest label, so a
vector of an evenly spread label meets about as many candidates at every size.

Equal vectors of a label stand as one, with their number. Lists over `tile` vectors are cut into tiles that are compared two
by two, so no task holds a long list. Tasks report, for each vector, how many others it links with, and a spanning forest of
the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, settle, stored
from .components import connected
from .simhash import Forest

THRESHOLD = 0.93
#: Fewest and most pivots, pivots for each square root of rows, vectors sampled for each pivot, the cosine that no two of them reach.
LEAST, MOST, GROWTH, SAMPLED, APART = 64, 4096, 4.0, 2, 0.7
NEAR, SHARED = 6, 2
TILE = 2048
#: Bits of a pivot's number in the name of a list, lists up to which pairs are looked at step by step, rows that one pass takes.
BITS, SHORT, PASS = 12, 128, 1 << 14
#: Most long lists whose sizes are broadcast (about 40 bytes each).
BROADCAST = 1 << 17


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors of one size, from _usable, scaled to length one in double precision."""
    kind = np.float32 if raw[0][0] == 4 else np.float64
    x = np.stack([np.frombuffer(v, kind, offset=kind().itemsize) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vector(x: pa.Scalar) -> np.ndarray | None:
    if not x.is_valid or not len(x) or x.values.null_count:
        return None
    v = x.values.to_numpy().astype(np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors with finite components and a length, as bytes: single precision where that says it all, behind its width."""
    for batch in batches:
        ids, labels, out = [], [], []
        for vec_id, label, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
            v = None if label is None else _vector(x)
            if v is not None:
                with np.errstate(over="ignore"):
                    small = v.astype(np.float32)
                same = (small == v).all()
                ids.append(vec_id)
                labels.append(label)
                out.append(b"\4\0\0\0" + small.tobytes() if same else b"\10\0\0\0\0\0\0\0" + v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, batch.schema.field(2).type), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _unusable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id of the rows that _usable leaves out."""
    for batch in batches:
        out = [i for i, label, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True) if label is None or _vector(x) is None]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["vec_id"])


def components_of(v: bytes) -> int:
    return len(v) // v[0] - 1


def apart(sample: Iterable[bytes], most: int) -> dict[int, np.ndarray]:
    """By number of components: `most` pivots, first those of the sample that have a cosine under APART with all before."""
    out: dict[int, tuple[list, np.ndarray]] = {}
    for raw in sample:
        v, size = matrix([raw])[0], components_of(raw)
        n, have = out.setdefault(size, ([0], np.zeros((most, size))))
        if n[0] < most and (not n[0] or (have[: n[0]] @ v).max() < APART):
            have[n[0]] = v
            n[0] += 1
    return {size: filled(have[: n[0]], most) for size, (n, have) in out.items()}


def filled(pivots: np.ndarray, most: int) -> np.ndarray:
    """Pivots, filled up with random directions, the same for each size."""
    rest = np.random.default_rng(5).normal(size=(most - len(pivots), pivots.shape[1]))
    return np.concatenate((pivots, rest / np.sqrt((rest * rest).sum(axis=1, keepdims=True))))


def _lists(pivots, count: int, near: int, shared: int):
    """(label, node, n, v) with `near` (16-bit numbers of the nearest pivots, ascending) and the names of its lists."""
    picks = np.array(list(combinations(range(near), shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = dict(pivots.value)
        for batch in batches:
            raw = batch.column(3).to_pylist()
            order = np.zeros((len(raw), near), np.int64)
            sizes = np.array([components_of(v) for v in raw], np.int64)
            widths = np.array([v[0] for v in raw], np.int64)
            for size, width in set(zip(sizes.tolist(), widths.tolist(), strict=True)):
                rows = np.flatnonzero((sizes == size) & (widths == width))
                p = by_size.get(size)
                if p is None:
                    p = by_size[size] = filled(np.zeros((0, size)), count)
                far = -(matrix([raw[k] for k in rows]) @ p.T)
                order[rows] = np.argpartition(far, near - 1, axis=1)[:, :near]
            order.sort(axis=1)
            names = (order[:, picks] << (BITS * np.arange(shared))).sum(axis=2)
            kept = [pa.array([x.tobytes() for x in order.astype(np.uint16)], pa.binary()), pa.array(list(names), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), *kept], [*batch.schema.names, "size", "near", "lists"])

    return run


GROUP = ["label", "size", "list", "i", "j"]


def _links(threshold: float, shared: int):
    """Sorted rows of tiles to (a, b, n): a links with n other vectors here; b is null but for edges of the forest, where n is null."""

    def links_of(x: np.ndarray, low: np.ndarray, side: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs whose cosine is `threshold` or more, of those that share no pivot in low."""
        bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        lengths = np.diff(bounds)
        alive = np.flatnonzero(np.repeat(lengths <= SHORT, lengths))
        step = 1
        while len(alive):  # short lists, all at once: each row with the one `step` rows on
            alive = alive[alive + step < len(x)]
            alive = alive[group[alive] == group[alive + step]]
            i, j = alive, alive + step
            keep = (side[i] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
            keep = ~((low[i][:, :, None] == low[j][:, None, :]) & (low[i] >= 0)[:, :, None]).any(axis=(1, 2))
            i, j = i[keep], j[keep]
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            yield i[keep], j[keep]
            step += 1
        for k in np.flatnonzero(lengths > SHORT):
            rows = np.arange(bounds[k], bounds[k + 1])
            left, right = rows[side[rows] != 2], rows[side[rows] != 1]
            if not len(left) or not len(right):
                continue
            named = np.unique(low[rows])
            has = np.zeros((len(rows), len(named)), np.float32)
            np.put_along_axis(has, np.searchsorted(named, low[rows]), 1, axis=1)
            has = has[:, named >= 0]
            if has[left - rows[0]].all(axis=0).any() and (side[rows] == 0).all():
                continue  # all share a lesser pivot
            held = has[right - rows[0]].T
            for at in range(0, len(left), 256):
                own = left[at : at + 256]
                may = (has[own - rows[0]] @ held) == 0
                if (side[rows] == 0).all():
                    may &= own[:, None] < right[None, :]
                if not may.any():
                    continue
                if may.mean() < 0.05:
                    i, j = np.nonzero(may)
                    i, j = own[i], right[j]
                    for part in range(0, len(i), PASS):
                        a, b = i[part : part + PASS], j[part : part + PASS]
                        keep = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                        yield a[keep], b[keep]
                else:
                    i, j = np.nonzero(may & (x[own] @ x[right].T >= threshold))
                    yield own[i], right[j]

    def solve(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        ids, n, side, key = (t[c].to_numpy() for c in ("node", "n", "side", "list"))
        near = np.frombuffer(b"".join(t["near"].to_pylist()), np.uint16).reshape(len(ids), -1).astype(np.int32)
        named = (key[:, None] >> (BITS * np.arange(shared))) & ((1 << BITS) - 1)
        low = np.where((near < named[:, -1:]) & ~(near[:, :, None] == named[:, None, :]).any(axis=2), near, -1)
        raw, size = t["v"].to_pylist(), t["size"].to_numpy()
        forest, total = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            x = np.zeros((len(rows), s))
            wide = np.array([raw[k][0] for k in rows])
            for w in np.unique(wide):
                x[wide == w] = matrix([raw[k] for k in rows[wide == w]])
            for i, j in links_of(x, low[rows], side[rows], group[rows]):
                i, j = rows[i], rows[j]
                np.add.at(total, i, n[j])
                np.add.at(total, j, n[i])
                forest.add(i, j)
        some = np.flatnonzero(total)
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        a = np.concatenate((ids[some], ids[e[:, 0]]))
        b = pa.array([None] * len(some) + ids[e[:, 1]].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(total[some].tolist() + [None] * len(e), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            for c in GROUP:
                x = t[c].combine_chunks()
                new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
            return np.cumsum(new)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < PASS:
                continue
            t = pa.Table.from_batches(held)
            group = groups(t)
            last = int(np.searchsorted(group, group[-1]))  # the last list may go on
            if last:
                yield solve(t.slice(0, last), group[:last])
                held = t.slice(last).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield solve(t, groups(t))

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, near: int = NEAR, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: links of vectors of equal label whose cosine is `threshold` or more.

    `pivots` is their number, `near` at least and MOST at most; None lets it grow with the largest label. Vectors that are
    null, zero, or hold null or non-finite components link with nothing, nor do those with a null label or of different
    lengths. Repeated rows are vectors of their own, linked with each other. A null vec_id links like any other;
    component_id is the smallest known vec_id reachable. Of pivots equally near those of lower number count. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    kind = rows.schema["label"].dataType.simpleString()
    good = rows.mapInArrow(_usable, f"vec_id long, label {kind}, v binary")
    classes = good.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    # a name for each class that no null can spoil
    classes = stored(classes.select("label", "v", "n", "first", F.xxhash64("label", "v").alias("node")), "vectors")
    settle(spark)
    if pivots is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        pivots = 1 << math.ceil(math.log2(max(LEAST, GROWTH * math.sqrt(largest))))
    pivots = max(near, min(MOST, pivots))
    sample = apart((bytes(r["v"]) for r in classes.select("v").orderBy(F.xxhash64("v", F.lit(1))).limit(SAMPLED * pivots).collect()), pivots)
    listed = classes.select("label", "node", "n", "v").mapInArrow(_lists(spark.sparkContext.broadcast(sample), pivots, near, shared), f"label {kind}, node long, n long, v binary, size int, near binary, lists array<long>")
    listed = stored(listed, "permutations")
    settle(spark)
    own_list = ["label", "size", "list"]
    large = listed.select("label", "size", F.explode("lists").alias("list")).groupBy(*own_list).count().where(F.col("count") > tile)
    large = stored(large.select(*own_list, F.ceil(F.col("count") / tile).cast("int").alias("g")), "long-lists")
    if large.count() <= BROADCAST:
        large = F.broadcast(large)
    entries = listed.withColumn("list", F.explode("lists")).drop("lists").join(large, own_list, "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("g").cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x == F.col("own"), 0).when(F.col("own") < x, 1).otherwise(2).alias("side")))
    entries = entries.withColumn("own", own).withColumn("t", F.explode(tiles)).select(*own_list, "t.i", "t.j", "t.side", "node", "n", "near", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
    found = stored(entries.mapInArrow(_links(threshold, shared), "a long, b long, n long"), "cosines")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "node")
    roots = connected(found.where("b is not null"), "a", "b")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(least, "root").join(degree, "node", "left").select("label", "v", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = good.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.mapInArrow(_unusable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
