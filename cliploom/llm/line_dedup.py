"""Repeated runs of lines, from a suffix array over the sequences of line ids of all documents.

The suffix array is built by prefix doubling, and only as far as repeats go. Round 1 ranks single lines; each further round
ranks pairs of the ranks so far, the second at the offset that the first reaches (at most doubling the length), until
prefixes of `least` lines are ranked. Suffixes whose rank is unique have no neighbour with a common prefix so long and are
dropped from later rounds. Equal ranks are an interval of the suffix array whose longest common prefix has `least` lines
at least. Within an interval suffixes stand by document and line: those after the first are later copies. How long the
common prefix of a later copy and the first of its interval is follows as in Kasai's method, from the next suffix of the
same document, whose common prefix with the next line of the first is shorter by one: consecutive copies of consecutive
lines are one maximal run. Later copies are deleted.

Ranks are 128-bit names (only equality counts, so any order of line ids will do). Survivors of each round are written to
the shared folder, and ranks are counted before they are joined, so that a line that many documents share is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, ensure_importable, settle, stored

LEAST = 3


def _repeated(rows: DataFrame, length: int) -> DataFrame:
    """Suffixes that share the prefix of `length` lines with another."""
    again = stored(rows.groupBy("a", "b").count().where("count > 1").select("a", "b"), "ranks")
    out = stored(rows.join(again, ["a", "b"], "left_semi"), f"suffixes-{length}")
    discard(again)
    settle(rows.sparkSession)
    return out


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h, s, a, b): the name (a, b) of line s of each text that has `least` lines."""
    lines = F.split("text", "\n", -1)
    name = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    rows = docs.select("doc_id", "h", lines.alias("lines")).where(F.size("lines") >= least)
    rows = rows.select("doc_id", "h", F.posexplode(F.transform("lines", name)).alias("s", "n"))
    return rows.select("doc_id", "h", F.col("s").cast("long"), "n.a", "n.b")


def suffixes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, h, s, a, b): suffixes, from line s, in intervals (a, b) of the suffix array whose common prefix has `least` lines.

    docs has one row for each doc_id and text hash h.
    """
    rows, length = _repeated(_lines(docs, least), 1), 1
    in_doc = W.partitionBy("doc_id", "h").orderBy("s").rangeBetween
    while length < least:
        step = min(length, least - length)
        after = [F.max(x).over(in_doc(step, step)) for x in ("a", "b")]
        longer = rows.select("doc_id", "h", "s", "a", "b", after[0].alias("c"), after[1].alias("d")).where("c is not null")
        longer = longer.select("doc_id", "h", "s", F.xxhash64("a", "c").alias("a"), F.xxhash64(F.lit(1), "b", "d").alias("b"))
        before, rows, length = rows, _repeated(longer, length + step), length + step
        discard(before)
    return rows


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, h, start, n, of_doc, of_h, of_start): maximal runs of n lines from line `start` that begin earlier too, at of_start.

    Earlier goes by doc_id, text hash and line; the place named is the earliest of the run's first `least` lines.
    """
    rows = suffixes(docs, least)
    here = F.struct("doc_id", "h", "s")
    first = stored(rows.groupBy("a", "b").agg(F.min(here).alias("first")), "intervals")
    copies = rows.join(first, ["a", "b"]).where(~here.eqNullSafe(F.col("first")))
    copies = copies.select("doc_id", "h", "s", F.col("first.doc_id").alias("of_doc"), F.col("first.h").alias("of_h"), (F.col("s") - F.col("first.s")).alias("ahead"))
    same = ["doc_id", "h", "of_doc", "of_h", "ahead"]
    place = F.col("s") - F.row_number().over(W.partitionBy(*same).orderBy("s"))
    found = copies.withColumn("run", place).groupBy(*same, "run").agg(F.min("s").alias("start"), (F.count("*") + least - 1).alias("n"))
    return found.select("doc_id", "h", "start", "n", "of_doc", "of_h", (F.col("start") - F.col("ahead")).alias("of_start"))


def _kept():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, text in enumerate(batch.column(1)):
                text, found = text.as_py() or "", batch.column(2)[row]
                n_lines, removed, runs = text.count("\n") + 1, 0, 0
                if found.is_valid and len(found):
                    begin, n = (found.values.field(k).to_numpy() for k in (0, 1))
                    change = np.zeros(n_lines + 3, np.int64)
                    np.add.at(change, begin + 1, 1)
                    np.add.at(change, begin + n + 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    runs = int((gone[1:] & ~gone[:-1]).sum())
                    removed = int(gone.sum())
                    text = "\n".join(x for x, g in zip(text.split("\n"), gone[1:].tolist(), strict=False) if not g)
                for to, v in zip(out, (n_lines, removed, runs, text), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)), *batch.columns[3:]], ["doc_id", "n_lines", "n_removed", "n_runs", "kept", *batch.schema.names[3:]])

    return run


def line_dedup(docs: DataFrame, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept and the columns in `carry`: texts without later copies of runs of lines.

    Lines end at newlines. A line goes if a run of `least` lines (two or more) that covers it also begins earlier, in the
    order of doc_id, text hash and line; a run that overlaps its own copy loses all but its first lines. A null text counts as one empty
    line; repeated rows (same doc_id, same text) count as one document and all get its result; a null doc_id comes first.
    Texts of any length are looked at whole. Columns beyond doc_id, text and `carry` are ignored, whatever their names. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    docs = docs.withColumn("h", F.xxhash64("text"))
    once = docs.where(F.contains("text", F.lit("\n"))).select("doc_id", "h", "text")
    copies = repeated_runs(once, least).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    same = F.expr("d.doc_id <=> m.doc_id and d.h = m.h")
    rows = docs.alias("d").join(copies.alias("m"), same, "left").select("d.doc_id", "text", "runs", *(F.col(f"carry_{c}") for c in carry))
    kinds = "".join(f", `carry_{c}` {docs.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)
    out = rows.mapInArrow(_kept(), "doc_id long, n_lines long, n_removed long, n_runs long, kept string" + kinds)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})
