"""Silence between words, speech runs, and times after silence is removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlap_join

#: Milliseconds of silence that count as long.
LONG = 700


def in_order(key: str = "video_id"):
    return W.partitionBy(key).orderBy("start_ms", "end_ms", "word_idx")


def said_until(key: str = "video_id") -> Column:
    """The latest end of any word before this one, so that nested words open no gap."""
    return F.max("end_ms").over(in_order(key).rowsBetween(W.unboundedPreceding, -1))


def gaps(words: DataFrame, long: int = LONG) -> DataFrame:
    """(video_id, gap_start, gap_end): long silences between words."""
    return words.withColumn("gap_start", said_until()).where(F.col("start_ms") - F.col("gap_start") > long).select("video_id", "gap_start", F.col("start_ms").alias("gap_end"))


def runs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(video_id, run, start_ms, end_ms, n_words): speech between long silences, numbered from 0."""
    new = F.coalesce((F.col("start_ms") - said_until() > long).cast("long"), F.lit(0))
    marked = words.withColumn("_new", new).withColumn("run", F.sum("_new").over(in_order()))
    return marked.groupBy("video_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))


def retime(words: DataFrame, long: int = LONG) -> DataFrame:
    """words with new_start and new_end, as they are once all long silences are cut out; words keep their length."""
    silence = F.col("start_ms") - said_until()
    cut = words.withColumn("_cut", F.when(silence > long, silence).otherwise(F.lit(0)))
    removed = F.coalesce(F.sum("_cut").over(in_order().rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    return cut.withColumn("_gone", removed).withColumn("new_start", F.col("start_ms") - F.col("_gone")).withColumn("new_end", F.col("end_ms") - F.col("_gone")).drop("_cut", "_gone")


def cut(words: DataFrame, start_ms: int | Column, end_ms: int | Column) -> DataFrame:
    """Words that a clip [start_ms, end_ms) touches, cut to it, with times from its beginning."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (start_ms, end_ms))
    kept = words.where((F.col("start_ms") < b) & (F.col("end_ms") > a))
    return kept.withColumn("start_ms", F.greatest("start_ms", a) - a).withColumn("end_ms", F.least("end_ms", b) - a)


def clip_words(words: DataFrame, clips: DataFrame, width: int = 3_600_000) -> DataFrame:
    """(clip_id, sent_idx, word_idx, start_ms, end_ms, word): the words of each clip (video_id, clip_id, start_ms, end_ms), as cut() does for one."""
    said = words.select("video_id", "sent_idx", "word_idx", "start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"), "word", F.col("end_ms").alias("_end"))
    pairs = overlap_join(said, clips.select("video_id", "clip_id", "start_ms", "end_ms"), "video_id", width).where("_end > r_start_ms")  # a word of no length is met as one of a millisecond
    pairs = pairs.withColumn("end_ms", F.col("_end"))
    begin = F.greatest("start_ms", "r_start_ms") - F.col("r_start_ms")
    return pairs.select(F.col("r_clip_id").alias("clip_id"), "sent_idx", "word_idx", begin.alias("start_ms"), (F.least("end_ms", "r_end_ms") - F.col("r_start_ms")).alias("end_ms"), "word")
