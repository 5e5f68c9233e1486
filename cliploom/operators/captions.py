"""Caption files from one caption table (video_id, start_ms, end_ms, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import ass_time, srt_time, vtt_time

ORDER = ("start_ms", "end_ms", "sent_idx")
#: The head of the ASS format with one style.
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour\nStyle: Default,{font},{size},{color}\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"


def joined(rows: DataFrame, line: Column, between: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(video_id, body): lines of each video in order."""
    listed = rows.select("video_id", F.struct(*order, line.alias("line")).alias("l")).groupBy("video_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return listed.select("video_id", F.array_join(F.col("l.line"), between).alias("body"))


def srt(captions: DataFrame) -> DataFrame:
    """(video_id, body): numbered blocks."""
    n = F.row_number().over(W.partitionBy("video_id").orderBy(*ORDER))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    return joined(captions.withColumn("n", n), block, "\n")


def vtt(captions: DataFrame) -> DataFrame:
    """(video_id, body): WEBVTT blocks."""
    block = F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    return joined(captions, block, "\n").withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def karaoke_lines(words: DataFrame) -> DataFrame:
    """(video_id, sent_idx, start_ms, end_ms, text): one line a sentence; each word lasts until the next begins, in centiseconds."""
    w = W.partitionBy("video_id", "sent_idx").orderBy("start_ms", "word_idx")
    until = F.coalesce(F.lead("start_ms").over(w), F.col("end_ms"))
    tag = F.concat(F.lit("{\\k"), (F.floor(until / 10) - F.floor(F.col("start_ms") / 10)).cast("string"), F.lit("}"), "word")
    tagged = words.withColumn("tag", tag).groupBy("video_id", "sent_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("start_ms", "word_idx", "tag"))).alias("t"))
    return tagged.select("video_id", "sent_idx", "start_ms", "end_ms", F.array_join(F.col("t.tag"), " ").alias("text"))


def ass_events(lines: DataFrame) -> DataFrame:
    """lines with `event`, the dialogue line."""
    return lines.withColumn("event", F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,"), "text"))


def ass(lines: DataFrame, font: str = "Arial", size: int = 48, color: str = "&H00FFFFFF") -> DataFrame:
    """(video_id, body): a whole ASS file."""
    out = joined(ass_events(lines), F.col("event"), "\n")
    return out.withColumn("body", F.concat(F.lit(ASS_HEAD.format(font=font, size=size, color=color)), "body", F.lit("\n")))
