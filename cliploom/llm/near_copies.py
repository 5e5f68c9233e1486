"""Near copies by exact Jaccard of word shingles: SimHash links, then an inverted list of prefixes; every link is verified.

First come pairs whose SimHash fingerprints (of the distinct shingles) differ in few bits, found by the pivot distance tables
of .simhash. They join most copies, but sets at a Jaccard of 0.8 differ in some ten of 64 bits, so they can't be all.

Sets of Jaccard `alike` or more share at least alike * n of the n shingles of either, so under any one order of all
shingles they share one of their first n - ceil(alike * n) + 1: no pair is missed. The order puts shingles that are common
in a bounded sample last, which keeps lists short; it has no influence on the result. Equal sets stand as one.

In long lists members are first compared with one leader, over rounds of other leaders as long as many pairs are open and rounds close a fifth of them; then all pairs of a list that
no link joins yet are candidates, long lists in tiles. Bounds on what they can have in common drop most: from sizes,
places in the lists and how many lists they are in, then from a sketch of each set, the number of its shingles in each of CELLS ranges of hashes (two sets
share no more than the lesser number in each). Neither drops a pair that is alike; every link is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, ensure_importable, settle, stored
from .components import connected

ALIKE, SHINGLE = 0.8, 5
TILE = 1024
#: Shingles whose bits are counted in one pass.
PASS = 1 << 16
#: Ranges of hashes that a sketch counts in.
CELLS = 256
#: Most rounds of leaders before all pairs, members of the lists that take part, open pairs for each entry of any list that
#: make an end of rounds.
ROUNDS, LONG, FEW = 8, 64, 4
#: Entries of a tile, about: lists of long texts are cut into more tiles. Rows of a name that count pair by pair; cells of a pass.
ENTRIES, LIGHT, CHUNK = 1 << 20, 48, 1 << 20
#: Most document numbers that are broadcast.
BROADCAST = 1 << 17
#: Documents of the sample, how many of them hold a common shingle, most common shingles kept.
SAMPLE, COMMON, KEPT = 4096, 8, 1 << 16


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of A-Z-lowered word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(begins, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(begins)))


def sketch(own: np.ndarray) -> bytes:
    """Shingles in each range, as 16-bit numbers; a set with more in any range than these hold has none (an empty sketch)."""
    cells = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return cells.astype("<u2").tobytes() if cells.max() < 1 << 16 else b""


def _maybe(alike: float):
    """Pairs that their sketches let be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both = np.flatnonzero([bool(i and j) for i, j in zip(x, y, strict=True)])
            if len(both):
                a, b = (np.frombuffer(b"".join(side[k] for k in both), "<u2").reshape(-1, CELLS).astype(np.int64) for side in (x, y))
                keep[both] = np.minimum(a, b).sum(axis=1) >= (a.sum(axis=1) + b.sum(axis=1)) * (alike / (1 + alike)) - 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), shingle).tobytes() for x in texts], pa.binary())], ["node", "set"])

    return run


def _listed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1).cast(pa.large_binary()).fill_null(b""):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), shingle).view(np.int64))], ["key"])

    return run


def _prefixes(common, alike: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value  # the commonest at the end
        by_hash = np.argsort(last)
        for batch in batches:
            nodes, sizes, prefixes, prints, sketches = [], [], [], [], []
            for x in batch.column(1).cast(pa.large_binary()).fill_null(b""):
                own = shingles(x.as_py(), shingle)
                place = np.zeros(len(own), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, own, sorter=by_hash), len(last) - 1)
                    place = np.where(last[by_hash[at]] == own, by_hash[at] + 1, 0)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                sizes.append(len(own))
                sketches.append(sketch(own))
                counts = sum((simhash.bit_counts(own[at : at + PASS]) for at in range(0, len(own), PASS)), np.zeros(64, np.int64))
                prints.append(simhash.majority(counts, len(own)))
                prefixes.append(own[np.lexsort((own, place))][: len(own) - math.ceil(alike * len(own) - 1e-9) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "node", "n", "prefix", "fp", "sketch"])

    return run


def _alike(alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[k] = both >= alike * (len(a) + len(b) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(4 * SAMPLE)
    rows = sample.mapInArrow(_listed(shingle), "key long").groupBy("key").count().where(F.col("count") >= COMMON)
    found = rows.orderBy(F.desc("count"), "key").limit(KEPT).select("key").toArrow()["key"].to_numpy()
    return found[::-1].astype(np.int64).view(np.uint64)


def _fingerprinted(once: DataFrame, distance: int) -> DataFrame:
    """(a, b): sets of equal fingerprint with the least of them, and those of fingerprints that SimHash links."""
    least = stored(once.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    same = once.join(least, "fp").where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select("fp"), distance)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _possible(alike: float, n: Column, m: Column, most: Column) -> Column:
    """Whether sets of n and m shingles with at most so many in common can be alike."""
    return most >= (n + m) * (alike / (1 + alike)) - 1e-6


def _led(entries: DataFrame, alike: float, k: int) -> DataFrame:
    """(a, b): members of a list with its leader of round k, where their roots differ.

    The first leader is the member with most company in its lists, in a group of edited copies the one least edited; later
    ones are of any root of the list, each as likely.
    """
    order = F.struct((-F.col("w")).alias("w"), "node", "n", "pos", "root") if k == 0 else F.struct(F.xxhash64("root", F.lit(k)).alias("h"), (-F.col("w")).alias("w"), "node", "n", "pos", "root")
    leaders = entries.groupBy("key").agg(F.min(order).alias("l"))
    met = entries.join(leaders, "key").where((F.col("root") != F.col("l.root")) & _possible(alike, F.col("n"), F.col("l.n"), _reach("", "l.")))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def _reach(x: str, y: str) -> Column:
    """What two sets can have in common, by the places of a shared shingle in either order: what is before it and from it on."""
    return F.least(f"{x}pos", f"{y}pos") + F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos"))


def _open_pairs(entries: DataFrame) -> int:
    """Pairs of a list whose roots differ, over all lists."""
    lists = entries.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return lists.agg(F.sum((F.col("c") * F.col("c") - F.col("same")).cast("decimal(38,0)"))).first()[0] or 0


def _needed(alike: float, x: str, y: str) -> Column:
    """Shingles that the prefixes of two sets must share: what they need in common less all that follows the shorter prefix."""
    rest = lambda side: F.ceil(F.col(f"{side}n") * alike - 1e-9) - 1
    return (F.col(f"{x}n") + F.col(f"{y}n")) * (alike / (1 + alike)) - F.greatest(rest(x), rest(y)) - 1e-6


def shared(row: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many names each row of `left` shares with each of `right`, of entries (row, name).

    Names of a few rows add to their pairs one by one, those of many rows as products of chunks; names of one row add
    nothing (a row is not compared with itself). Beside the entries this holds the counts of the pairs and one chunk.
    """
    out = np.zeros((len(left), len(right)), np.int32)
    if not len(name):
        return out
    n_rows = int(row.max()) + 1
    of_left, of_right = np.full(max(n_rows, left.max() + 1, right.max() + 1), -1), np.full(max(n_rows, left.max() + 1, right.max() + 1), -1)
    of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    sizes = np.diff(np.append(starts, len(name)))
    for c in np.unique(sizes[(sizes > 1) & (sizes <= LIGHT)]).tolist():
        own, step = starts[sizes == c], max(1, CHUNK // (c * c))
        for at in range(0, len(own), step):
            rows = row[own[at : at + step, None] + np.arange(c)]
            a, b = of_left[rows][:, :, None], of_right[rows][:, None, :]
            cell = (a * len(right) + b)[(a >= 0) & (b >= 0)]
            out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.int32)
    many = np.flatnonzero(sizes > LIGHT)
    step = max(1, CHUNK // len(of_left))
    for at in range(0, len(many), step):
        x = many[at : at + step]
        has = np.zeros((len(of_left), len(x)), np.float32)
        for k, m in enumerate(x):
            has[row[starts[m] : starts[m] + sizes[m]], k] = 1
        out += (has[left] @ has[right].T).astype(np.int32)
    return out


def _met(alike: float):
    """Sorted rows of tiles to pairs (a, b) that all bounds let be alike, each in the first long list that both are in."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, pos, root, node, short, side = (t[c].to_numpy() for c in ("n", "pos", "root", "node", "short", "side"))
        key, lists = t["key"][0].as_py(), t["lists"].combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        place = np.flatnonzero(flat == key) - (np.cumsum(sizes) - sizes)  # once in each row
        early = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < place[row]
        rest = np.ceil(n * alike - 1e-9) - 1
        cells = [np.frombuffer(x, "<u2").astype(np.int64) if x else None for x in t["sketch"].to_pylist()]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        same = bool((side == 0).all())
        both, before = shared(row, flat, left, right), shared(row[early], flat[early], left, right)
        for start in range(0, len(left), 256):
            x = left[start : start + 256]
            need = (n[x][:, None] + n[right][None, :]) * (alike / (1 + alike))
            may = (before[start : start + 256] == 0) & (root[x][:, None] != root[right][None, :])
            if same:
                may &= x[:, None] < right[None, :]
            may &= np.minimum(pos[x][:, None], pos[right][None, :]) + np.minimum((n - pos)[x][:, None], (n - pos)[right][None, :]) >= need - 1e-6
            may &= both[start : start + 256] + np.minimum(short[x][:, None], short[right][None, :]) >= need - np.maximum(rest[x][:, None], rest[right][None, :]) - 1e-6
            i, j = np.nonzero(may)
            need, i, j = need[i, j], x[i], right[j]
            keep = np.array([a is None or b is None or np.minimum(a, b).sum() >= m - 1e-6 for a, b, m in zip((cells[k] for k in i), (cells[k] for k in j), need, strict=True)], bool)
            a, b = node[i[keep]], node[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if at == end:
                    continue
                if last is not None and last != tuple(keys[at].tolist()):
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                last = tuple(keys[at].tolist())
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _pairs(entries: DataFrame, sketches: DataFrame, alike: float, tile: int, long: int) -> DataFrame:
    """(a, b): pairs of a list whose roots differ and that the bounds let be alike.

    A shingle that only one set has is in no list, so two sets share at most as many shingles of their prefixes as the
    lesser of them has entries. In lists over `long` members a task counts what two sets share there, and looks at their
    sketches, before it names a pair; lists over `tile` members, or whose members are in more than ENTRIES long lists in all,
    are compared tile by tile.
    """
    kept = entries.groupBy("node").agg(F.count("*").alias("r"), F.count_if(F.col("c") <= long).alias("short"), F.sort_array(F.collect_list(F.when(F.col("c") > long, F.struct("pos", "key")))).alias("l"))
    kept = stored(kept.select("node", "r", "short", F.col("l.key").alias("lists")), "near-kept")
    rows = entries.where(F.col("c") > long).select("key", "node", "n", "pos", "root", "c")
    wide = rows.join(kept.select("node", F.size("lists").alias("k")), "node").groupBy("key").agg(F.sum("k").alias("e"))
    rows = rows.join(wide, "key").withColumn("g", F.greatest(F.ceil(F.col("c") / tile), F.ceil(F.col("e") / ENTRIES)).cast("int")).drop("c", "e")
    rows = rows.join(kept.where(F.size("lists") > 0).join(sketches, "node").select("node", "short", "lists", "sketch"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("g").cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x == F.col("own"), 0).when(F.col("own") < x, 1).otherwise(2).alias("side")))
    rows = rows.withColumn("own", own).withColumn("t", F.explode(tiles)).select("key", "t.i", "t.j", "t.side", "node", "n", F.col("pos").cast("long"), "root", "short", "lists", "sketch")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    met_long = rows.mapInArrow(_met(alike), "a long, b long")
    few = entries.where(F.col("c") <= long).join(kept.select("node", "r"), "node").select("key", "node", "n", "pos", "root", "r")
    x, y = few.alias("x"), few.alias("y")
    may = F.expr("x.key = y.key and x.root != y.root and x.node < y.node") & _possible(alike, F.col("x.n"), F.col("y.n"), _reach("x.", "y.")) & (F.least("x.r", "y.r") >= _needed(alike, "x.", "y."))
    met = x.join(y, may).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return met.union(met_long).distinct()


def jaccard_groups(docs: DataFrame, alike: float = ALIKE, shingle: int = SHINGLE, tile: int = TILE, rounds: int = ROUNDS, distance: int = simhash.DISTANCE) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs whose shingles have Jaccard `alike` or more).

    docs has one text for each doc_id; repeated rows give repeated rows. Null and blank texts are alike. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(_common(docs, shingle))  # KEPT numbers at most
    prints = stored(docs.mapInArrow(_prefixes(common, alike, shingle), "doc_id long, node long, n long, prefix array<long>, fp long, sketch binary"), "near-prefixes")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first")), "near-firsts")
    once = prints.join(nodes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"]).dropDuplicates(["node"])
    entries = once.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    again = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    entries = stored(entries.join(again, "key"), "near-entries")
    settle(spark)

    sketches = stored(once.select("node", "sketch"), "near-sketches")

    def sided(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """Pairs with `column` of both."""
        rows = pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
        return rows.join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "near-pairs")
        likely = stored(sided(pairs, sketches.join(ends(pairs), "node", "left_semi"), "sketch").mapInArrow(_maybe(alike), "a long, b long"), "near-likely")
        discard(pairs)
        settle(spark)
        some = stored(nodes.join(ends(likely), "node").select("node", F.col("first").alias("doc_id")), "near-nodes")
        ids = F.broadcast(some) if some.count() <= BROADCAST else some
        sets = stored(docs.join(ids, "doc_id").select("node", "text").mapInArrow(_sets(shingle), "node long, set binary"), "near-sets")
        out = stored(sided(likely, sets.dropDuplicates(["node"]), "set").mapInArrow(_alike(alike), "a long, b long"), "near-links")
        discard(likely, some, sets)
        settle(spark)
        return out

    long = entries.where(F.col("c") > LONG)
    long = stored(long.join(long.groupBy("node").agg(F.sum("c").alias("w")), "node"), "near-long")
    few = FEW * entries.count()
    links = verified(_fingerprinted(once.select("node", "fp"), distance))
    roots = connected(links, "a", "b")
    before = now = None
    for k in range(rounds):
        if now is not None:
            discard(now)
        now = stored(long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
        pairs = int(_open_pairs(now))
        if pairs <= few or before and pairs > 0.8 * before:
            break
        before = pairs
        links = links.union(verified(_led(now, alike, k)))
        roots = connected(links, "a", "b")
    if now is not None:
        discard(now)
    discard(long)
    now = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = links.union(verified(_pairs(now, sketches, alike, tile, LONG)))
    discard(entries, sketches)
    roots = connected(links, "a", "b")
    roots = stored(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "near-roots")
    least = stored(roots.groupBy("root").agg(F.min("first").alias("component_id")), "near-least")
    return prints.select("doc_id", "node").join(roots.join(least, "root").select("node", "component_id"), "node")
