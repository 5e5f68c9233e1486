"""Prefix trie of conversations: shared beginnings, what they save, and how many ways they end.

Turns are numbered by one sort of all turns over ranges, so that a conversation of any length is spread over tasks. A node is
named by a digest of its turns: a chain of SHA-256 within BLOCK turns; whole blocks before it are named by doubling (spans
of one block, two, four ...), so a conversation of n turns takes log2(n / BLOCK) rounds, not n.

Nodes are keyed by their digest and point to their parent's. Counts of leaves and savings reach all ancestors by pointer
jumping: in round r each node adds its sums so far to its ancestor 2^r levels up, sums first, and its pointer becomes its
ancestor's; log2(depth) rounds of joins that all are tables in the shared folder. Many nodes under one ancestor are summed
before the shuffle; pointers to it meet by a join that the adaptive plan splits. The root is never looked up.

Numbers of conversations that end in a node are sorted over ranges and joined to texts of CHUNK numbers; a digest is
sequential by nature, so only these texts pass through one task, one at a time.

Turns go by turn, null first; turns of equal number by role, then text. Null role and text are empty. Rows without conv_id
are ignored. Repeated rows are turns like others. Texts of any length are digested whole. Other columns are ignored. No
conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import discard, ensure_importable, stored

BLOCK, CHUNK = 64, 4096
#: First bytes of what is digested: a turn after others, a span of blocks, a place after whole blocks.
TURN, SPAN, PLACE = b"\x00", b"\x01", b"\x02"
#: The root's name.
ROOT = b""


def _digest(*parts: object) -> F.Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns from 0 in their order, with a digest of role and text. Texts are sorted only where turns tie."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumns({"digest": digest, "words": F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")})
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    if rows.groupBy("conv_id", "turn").count().where("count > 1").isEmpty():
        rows = rows.drop("role", "text")
    else:
        order += ["role", "text"]
    rows = numbered(stored(rows, "turn-digests"), order, "at")
    begin = rows.groupBy("conv_id").agg(F.min("at").alias("begin"))
    return rows.join(begin, "conv_id").select("conv_id", (F.col("at") - F.col("begin")).alias("pos"), "digest", "words")


def _chained(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = last = None
        for batch in batches:
            names, before = [], []
            for c, pos, digest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                last = last if c == conv and pos % block else None
                before.append(last)
                conv, last = c, hashlib.sha256(TURN + (last or b"") + digest).digest()
                names.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary()), pa.array(before, pa.binary())], ["conv_id", "pos", "digest", "words", "name", "parent"])

    return run


def _block_names(whole: DataFrame) -> DataFrame:
    """(conv_id, block, name): a digest of all blocks up to this one, of (conv_id, block, name of the block alone); log2 rounds of doubling."""
    now, span = whole, 1
    while not now.where(F.col("block") >= span).isEmpty():
        before = now.select("conv_id", (F.col("block") + span).alias("block"), F.col("name").alias("earlier"))
        joined = now.join(before, ["conv_id", "block"], "left")
        after = stored(joined.select("conv_id", "block", F.when(F.col("earlier").isNull(), F.col("name")).otherwise(_digest(F.lit(SPAN), "earlier", "name")).alias("name")), "block-names")
        if now is not whole:
            discard(now)
        now, span = after, 2 * span
    return now


def named_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, name, parent, words): the node that each turn (conv_id, pos, digest, words) leads to and the one above it."""
    ensure_importable(turns.sparkSession)
    rows = turns.select("conv_id", "pos", "digest", "words").repartition("conv_id", F.floor(F.col("pos") / block)).sortWithinPartitions("conv_id", "pos")
    rows = rows.mapInArrow(_chained(block), "conv_id long, pos long, digest binary, words long, name binary, parent binary")
    rows = stored(rows.select("conv_id", "pos", F.floor(F.col("pos") / block).alias("block"), "name", "parent", "words"), "chained")
    out = rows.withColumn("parent", F.coalesce("parent", F.when(F.col("pos") == 0, F.lit(ROOT))))
    if not rows.where("block > 0").isEmpty():
        ends = stored(rows.where(F.col("pos") % block == block - 1).select("conv_id", "block", "name"), "whole-blocks")
        spans = _block_names(ends)
        up_to = spans.select("conv_id", (F.col("block") + 1).alias("block"), F.col("name").alias("all"))
        last = ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("name").alias("end"))
        earlier = up_to.select("conv_id", (F.col("block") + 1).alias("block"), F.col("all").alias("all_but_one"))
        placed = lambda spans, name: F.when(F.col(spans).isNull(), F.col(name)).otherwise(_digest(F.lit(PLACE), spans, name))
        out = out.join(up_to, ["conv_id", "block"], "left").join(last, ["conv_id", "block"], "left").join(earlier, ["conv_id", "block"], "left")
        parent = F.when(F.col("parent").isNull(), placed("all_but_one", "end")).when(F.col("pos") == 0, F.col("parent")).otherwise(placed("all", "parent"))
        out = out.withColumn("parent", parent).withColumn("name", placed("all", "name"))
    return out.select("conv_id", (F.col("pos") + 1).alias("depth"), "name", "parent", "words")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) to (name, first, ids): up to CHUNK numbers joined by commas."""
    held: list[int] = []
    name = None

    def text() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array(held[:1], pa.int64()), pa.array([",".join(map(str, held))])], ["name", "first", "ids"])

    for batch in batches:
        for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (x != name or len(held) == CHUNK):
                yield text()
                held = []
            name = x
            held.append(c)
    if held:
        yield text()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts to the SHA-256 of each name's, joined by commas."""
    name, state, done = None, None, []
    for batch in batches:
        for x, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or x != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = x, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["name", "ends_sha256"])
        done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id)."""
    ensure_importable(ends.sparkSession)
    texts = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_texts, "name binary, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends_sha256 string")


def rollup(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(name, *sums): the columns of nodes (name, parent, *sums) summed over each node's subtree, itself included, by pointer jumping.

    The root has a null parent. Rounds are as many as the depth has binary digits.
    """
    state = nodes.select("name", F.col("parent").alias("above"), *sums)
    while not state.where("above is not null").isEmpty():
        added = state.where("above is not null").groupBy(F.col("above").alias("name")).agg(*(F.sum(c).alias(f"{c}_below") for c in sums))
        target = state.select(F.col("name").alias("above"), F.col("above").alias("next"))
        jumped = state.where((F.col("above") != F.lit(ROOT)) & F.col("above").isNotNull()).select("name", "above").join(target, "above").select("name", "next")
        after = state.drop("above").join(jumped, "name", "left").join(added, "name", "left")
        after = stored(after.select("name", F.col("next").alias("above"), *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums)), "rollup")
        discard(state)
        state = after
    return state.drop("above")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and name and parent (digests) of each node.

    turns is (conv_id, pos, digest, words), as numbered_turns() gives it; convs (conv_id) names conversations without turns
    too. Columns: smallest member, turns of the node, smallest member of the node above, members, nodes directly below,
    nodes below without any of their own, words that need not be kept twice, summed over the subtree, and the members that
    end here.
    """
    rows = stored(named_turns(turns, block), "trie-turns")
    sizes = rows.groupBy("conv_id").agg(F.max("depth").alias("n"))
    if convs is not None:
        sizes = convs.select("conv_id").distinct().join(sizes, "conv_id", "left").na.fill(0, ["n"])
    sizes = stored(sizes, "trie-sizes")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    nodes = rows.groupBy("name", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).union(root)
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes2 = stored(nodes.join(children, "name", "left").na.fill(0, ["n_children"]), "trie-children")
    own = nodes2.select("name", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = rollup(own, ["n_leaves", "saved_tokens"])
    ends = rows.join(sizes, ["conv_id"]).where("depth = n").select("name", "conv_id").union(sizes.where("n = 0").select(F.lit(ROOT), "conv_id"))
    ends = stored(ends_digest(stored(ends, "trie-ends")), "trie-digests")
    least = root.select(F.col("conv_id").alias("root_conv"))
    top = (r := least.first()) and r.root_conv
    above = nodes.where(F.col("name") != F.lit(ROOT)).select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes2.where("depth > 1").select("name", "parent").join(above, "parent").select("name", "parent_conv_id")
    out = nodes2.join(summed, "name").join(ends, "name", "left").join(deep, "name", "left")
    parent = F.when(F.col("depth") == 1, F.lit(top).cast("long")).otherwise(F.col("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "name", "parent")


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: (turns, conv_ids).

    Conversation c takes the first h turns of conversation c - c % every (all if it has fewer, none if there is no such
    one), then its own from the h-th on; h is crc32 of its decimal number modulo `most`.
    """
    turns = stored(turns, "graft-turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stored(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "grafts")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    first = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    given = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where(F.col("pos") < F.col("taken")).select("conv_id", "pos", "digest", "words")
    return own.union(given), convs.select("conv_id")
