"""Exact repeats of long byte strings across documents, by distributed prefix doubling over sampled suffixes.

Doubling over every byte position would sort some 20 bytes for each byte of text in every one of nine rounds. Here only
sampled positions (anchors) are sorted. An anchor is the smallest hashed 16-gram of some window of `window` 16-grams; its
choice rests on the bytes of that window alone, so equal strings choose equal anchors, and each start of a `length`-byte
string belongs to exactly one anchor, at most window - 1 bytes ahead of it. Rounds, each a sort of (rank, next piece) pairs
that drops what is unique:

1. the first length - window + 1 bytes after each anchor; a unique anchor belongs to no repeat;
2. survivors, with rank and the piece up to all bytes of all strings of that anchor: where a pair repeats, all of them do;
3. the rest in blocks of `BLOCK` neighbouring starts: first the bytes that a block's strings share, then all their bytes;
4. what is left at the edges of repeats, each single start with its `length` bytes.

In rounds 3 and 4 one member stands for all with an equal pair (a repeated row names its starts twice, but none of them
is in question then).

Ranks are 64-bit names of byte ranges (two independent ones, one of them also modulo a prime, where they decide). Only equality counts
here, so names need no order. What each round leaves is written to the shared folder.

A pass holds about a hundred bytes for each byte of text it looks at, so a text of over SLICE bytes is looked at in slices
of that many starts, each with the bytes that its last string needs. An anchor on a border of slices stands twice, with
some of its starts each time; the rounds after the first decide about these as about any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, discard, ensure_importable, keyed, settle, slices, stored

LENGTH = 400
WINDOW = 128
GRAM = 16
BLOCK = 16
#: Starts of one pass over a long text: some 100 MB.
SLICE = 1 << 20


def _anchor_rows(offsets: np.ndarray, data: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """document, bytes from the first start to the anchor, first start, starts less one, rank of the anchor, rank of all its strings."""
    sizes = np.diff(offsets)
    starts_of = np.maximum(sizes - length + 1, 0)
    if not starts_of.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    names, more = Ranges(data, 1), Ranges(data, 2, prime=True)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    key = names.name(at, at + GRAM)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= at.astype(np.uint64)
    done = 1
    while done < window:  # smallest of the window, the leftmost of equal ones
        step = min(done, window - done)
        key = np.minimum(key[: len(key) - step], key[step:])
        done += step
    doc = np.repeat(np.arange(len(sizes)), starts_of)
    first = np.cumsum(starts_of) - starts_of
    start = np.arange(len(doc)) - first[doc] + offsets[:-1][doc]
    anchor = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    end = np.concatenate((new[1:], [len(doc)])) - 1
    doc, anchor, lo, hi = doc[new], anchor[new], start[new], start[end]
    core = names.name(anchor, anchor + length - window + 1)
    full = more.name(lo, hi + length) + (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return doc, anchor - lo, lo - offsets[:-1][doc], hi - lo, core, full


def _cut(batch: pa.RecordBatch, more: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int]]:
    """Parts of a batch as slices() gives them, with 0 and -1; one text over SLICE bytes in parts of that many places, each
    with `more` bytes after them: part, offsets, bytes, first place, end of places."""
    for part, offsets, data in slices(batch, most=SLICE):
        if len(data) <= SLICE:
            yield part, offsets, data, 0, -1
            continue
        for at in range(0, len(data), SLICE):
            own = data[at : at + SLICE + more]
            yield part, np.array([0, len(own)]), own, at, at + SLICE


def _anchors(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offsets, data, begin, _ in _cut(batch, length - 1):
                doc, ahead, lo, span, core, full = _anchor_rows(offsets, data, length, window)
                lo, rows = lo + begin, pa.array(doc)
                for at in range(0, len(doc), 1 << 16):
                    to = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(core[to].view(np.int64)), pa.array(full[to].view(np.int64)), part.column(0).take(rows[to]), pa.array((lo[to] * window + span[to]) * window + ahead[to])], ["core", "u", "key", "at"])

    return run


def _blocks(length: int, window: int):
    """Anchors in question to blocks of starts: rank of what their strings share, ranks of all their bytes."""

    def rows(marks: np.ndarray, base: int, names: Ranges, more: Ranges) -> list[np.ndarray]:
        need, marks = marks % 2, marks // 2
        ahead, span, lo = marks % window, marks // window % window, marks // window**2
        first, last = (ahead - span) // BLOCK, ahead // BLOCK
        n = last - first + 1
        which = np.repeat(np.arange(len(n)), n)
        block = first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
        least = np.maximum(block * BLOCK, (ahead - span)[which])
        most = np.minimum(block * BLOCK + BLOCK - 1, ahead[which])
        anchor = (lo + ahead)[which] + base
        shared = anchor - block * BLOCK
        core = names.name(shared, shared + length - BLOCK + 1) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        i, j = anchor - most, anchor - least + length
        return [core, names.name(i, j), more.name(i, j), (i - base) * window + (most - least), need[which]]

    return _named(rows, ["core", "u", "v", "at", "need"], length, window, 2 * window**2)


def _starts(length: int, window: int):
    """Blocks in question to single starts with the rank of their string."""

    def rows(marks: np.ndarray, base: int, names: Ranges, more: Ranges) -> list[np.ndarray]:
        need, marks = marks % 2, marks // 2
        lo, n = marks // window, marks % window + 1
        which = np.repeat(np.arange(len(lo)), n)
        at = lo[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
        i = at + base
        return [names.name(i, i + length), more.name(i, i + length), at * window, need[which]]

    return _named(rows, ["u", "v", "at", "need"], length, window, 2 * window)


def _named(rows, columns: list[str], length: int, window: int, unit: int):
    """(key, text, marks) to key and what `rows` makes of the marks of each text; a mark begins at mark // unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offsets, data, begin, end in _cut(batch, length + 2 * window + BLOCK):
                marks = [part.column(2)[k].values.to_numpy() for k in range(part.num_rows)]
                if end >= 0:  # a slice of one long text: the marks that begin in it
                    marks = [m[(m // unit >= begin) & (m // unit < end)] for m in marks]
                if not sum(map(len, marks)):
                    continue
                names, more = Ranges(data, 1), Ranges(data, 2, prime=True)
                made = [rows(m, offsets[k] - begin, names, more) for k, m in enumerate(marks)]
                ids = pa.array(np.repeat(np.arange(part.num_rows), [len(x[0]) for x in made]))
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(ids), *arrays], ["key", *columns])

    return run


def _settled(rows: DataFrame, rank: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows in need whose rank (all its columns) repeats; marks by document of those still in question and of their like; tables both rest on.

    Rows that share the first column of rank may still share strings; one of each rank is enough to find out. Classes are
    counted before any join, and both sides of every join are tables, so that a rank that many rows share is split.
    """
    classes = stored(rows.groupBy(*rank).agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "need")).alias("rep")), "classes")
    several = stored(classes.groupBy(rank[0]).count().where("count > 1").select(rank[0]), "several")
    question = classes.join(several, rank[0], "left_semi").select("rep.key", (F.col("rep.at") * 2 + F.when(F.col("n") == 1, F.col("rep.need")).otherwise(0)).alias("mark"))
    repeated = rows.where("need = 1").join(classes.where("n > 1").select(*rank), rank, "left_semi").select("key", "at")
    return repeated, question.groupBy("key").agg(F.collect_list("mark").alias("marks")), [rows, classes, several]


def spans_of(marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs covered by the ranges (begin, end) in the rows of marks."""
    marks = marks[np.argsort(marks[:, 0], kind="stable")]
    until = np.maximum.accumulate(np.minimum(marks[:, 1], size))
    new = np.flatnonzero(np.concatenate(([True], marks[1:, 0] > until[:-1])))  # ranges that touch are one run
    return marks[new, 0], until[np.append(new[1:], len(marks)) - 1]


def _kept(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            out: list[list] = [[], [], [], [], [], []]
            for row, text in enumerate(texts):
                data = text.as_py()
                marks = batch.column(2)[row]
                begins = ends = np.zeros(0, np.int64)
                if marks.is_valid and len(marks):
                    x = marks.values.to_numpy()
                    begins, ends = spans_of(np.stack((x // window, x // window + x % window + length), 1), len(data))
                kept = b"".join(data[i:j] for i, j in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)) if len(begins) else data
                for to, v in zip(out, (len(data), len(data) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)), *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"] + batch.schema.names[3:])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), kept_text and the columns in `carry`.

    A byte goes if a `length`-byte string that covers it starts anywhere else too; kept_text is kept without characters cut
    in two. A null text is empty; texts shorter than `length` bytes keep all. Repeated rows repeat each other and lose all
    but short texts; null doc_ids are documents like others. Texts of any length are taken whole, in slices of bounded
    memory. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry)))
    long = docs.where(F.octet_length("text") >= length).select("key", "text")

    def named(marks: DataFrame, how, kinds: str) -> DataFrame:
        texts = long.join(marks, "key").select("key", "text", "marks")
        return texts.mapInArrow(how(length, window), f"key long, {kinds}at long, need long")

    anchors = long.mapInArrow(_anchors(length, window), "core long, u long, key long, at long")
    again = stored(anchors.groupBy("core").count().where("count > 1").select("core"), "ranks")
    left = stored(anchors.join(again, "core", "left_semi").withColumn("need", F.lit(1).cast("long")), "anchors")
    discard(again)
    settle(spark)
    by_anchor, marks, used = _settled(left, ["core", "u"])
    blocks = stored(named(marks, _blocks, "core long, u long, v long, "), "blocks")
    by_anchor = stored(by_anchor.select("key", F.expr(f"at div {window}").alias("at")), "repeats")
    discard(*used)
    settle(spark)
    by_block, marks, used = _settled(blocks, ["core", "u", "v"])
    starts = stored(named(marks, _starts, "u long, v long, "), "starts")
    by_block = stored(by_block, "repeats")
    discard(*used)
    settle(spark)
    twice = stored(starts.groupBy("u", "v").count().where("count > 1").select("u", "v"), "ranks")
    single = stored(starts.where("need = 1").join(twice, ["u", "v"], "left_semi").select("key", "at"), "repeats")
    discard(starts, twice)
    marks = by_anchor.union(by_block).union(single).groupBy("key").agg(F.collect_list("at").alias("marks"))
    out = docs.join(marks, "key", "left").select("doc_id", "text", "marks", *(F.col(f"carry_{c}") for c in carry))
    kinds = "".join(f", `carry_{c}` {docs.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)
    out = out.mapInArrow(_kept(length, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string" + kinds)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})

