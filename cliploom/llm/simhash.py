"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Pivot distance tables: each fingerprint carries its Hamming distances to reference fingerprints. By the triangle
inequality two fingerprints whose distances to any pivot differ by more than d differ in more than d bits, so the pair
is discarded unread; survivors are verified by xor and bit count. The table alone would leave all pairs to be looked
at, so it works within buckets: 64 bits are cut into d + 2 parts, and two fingerprints within d bits agree on two of
them at least. Every pair of parts is a bucket key; nothing is lost. Buckets over `tile` rows are cut into tiles that
are compared two by two, so no task holds a large bucket. Each task reports only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, stored
from .components import connected

DISTANCE = 3
TILE = 2048
N_PIVOTS = 16
SHINGLE = 3


def fingerprint(text: bytes, shingle: int = SHINGLE, limit: int = 1 << 16) -> int:
    """SimHash of A-Z-lowered word shingles under XXH64 with seed 42; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), limit):
        counts += bit_counts(np.array([digest(joined[i:j], 42) for i, j in zip(begins[at : at + limit], ends[at : at + limit], strict=True)], np.uint64))
    return majority(counts, len(ends))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of 64 bits, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of n hashes have."""
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row per document; a null text counts as empty."""
    ensure_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def parts(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the distance + 2 parts of 64 bits."""
    n = distance + 2
    cuts = [64 * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def roots(self) -> np.ndarray:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return self.label
            self.label = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.roots()
        new = label[i] != label[j]
        if not new.any():
            return
        parent = label
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def linked(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int, n_pivots: int) -> np.ndarray:
    """Spanning forest (rows of two indices) of the links within each group; sides 1 and 2 are only compared with each other."""
    pivots = np.random.default_rng(7).integers(0, 2**64, n_pivots, dtype=np.uint64)
    table = np.stack([bit_count(fp ^ p) for p in pivots]).astype(np.int16) if len(fp) else np.zeros((n_pivots, 0), np.int16)
    order = np.lexsort((table[0], group))
    fp, group, side, table = fp[order], group[order], side[order], table[:, order]
    forest, alive, step = Forest(len(fp)), np.arange(len(fp)), 1
    while len(alive):
        alive = alive[alive + step < len(fp)]
        other = alive + step
        near = (group[alive] == group[other]) & (table[0][other] - table[0][alive] <= distance)
        alive = alive[near]  # sorted by the first pivot's distance: no later partner can be nearer
        i, j = alive, alive + step
        keep = (side[i] == 0) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        for row in table[1:]:
            keep = np.abs(row[i] - row[j]) <= distance
            i, j = i[keep], j[keep]
        keep = bit_count(fp[i] ^ fp[j]) <= distance
        forest.add(i[keep], j[keep])
        step += 1
    return order[np.array(forest.edges, np.int64).reshape(-1, 2)]


def _links(distance: int, n_pivots: int, least: int = 1 << 15):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            fp = t["fp"].to_numpy().view(np.uint64)
            keys = [t[c].to_numpy() for c in ("k", "key", "i", "j")]
            change = np.any([x[1:] != x[:-1] for x in keys], axis=0) if len(fp) else np.zeros(0, bool)
            group = np.concatenate(([0], np.cumsum(change)))[: len(fp)]
            e = linked(fp, group, t["side"].to_numpy(), distance, n_pivots)
            return pa.RecordBatch.from_arrays([pa.array(fp[e[:, 0]].view(np.int64)), pa.array(fp[e[:, 1]].view(np.int64))], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            if n >= least and batch.num_rows:  # cut where a new group begins
                last = [held[-1].column(c)[-1].as_py() for c in ("k", "key", "i", "j")]
                new = np.any([batch.column(c).to_numpy() != x for c, x in zip(("k", "key", "i", "j"), last, strict=True)], axis=0)
                cut = int(np.argmax(new)) if new.any() else batch.num_rows
                held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    continue
                yield solve(held)
                held, n, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield solve(held)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE, n_pivots: int = N_PIVOTS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to span every component."""
    ensure_importable(fps.sparkSession)
    cut = parts(distance)
    keys = [F.struct(F.lit(n).alias("k"), (F.shiftrightunsigned("fp", cut[x][0]).bitwiseAND((1 << cut[x][1]) - 1) * (1 << cut[y][1]) + F.shiftrightunsigned("fp", cut[y][0]).bitwiseAND((1 << cut[y][1]) - 1)).alias("key")) for n, (x, y) in enumerate(combinations(range(len(cut)), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.k", "b.key")
    large = rows.groupBy("k", "key").count().where(F.col("count") > tile).select("k", "key", F.ceil(F.col("count") / tile).cast("int").alias("g"))
    rows = rows.join(large, ["k", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("g").cast("long")).cast("int")
    # tile (i, j), i <= j: i = j compares a part with itself, i < j compares part i (side 1) with part j (side 2)
    tiles = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x == F.col("own"), 0).when(F.col("own") < x, 1).otherwise(2).alias("side")))
    rows = rows.withColumn("own", own).select("fp", "k", "key", F.explode(tiles).alias("t")).select("fp", "k", "key", "t.i", "t.j", F.col("t.side").alias("side"))
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j")
    return rows.mapInArrow(_links(distance, n_pivots), "a long, b long")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, tile: int = TILE, n_pivots: int = N_PIVOTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null or blank texts have fingerprint zero and link like any other. Repeated rows give repeated rows. A null doc_id
    keeps its row; its component_id is the smallest known doc_id of its group, or null. Other columns are ignored. An
    empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(prints.select("fp").distinct(), distance, tile, n_pivots), "a", "b")
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
