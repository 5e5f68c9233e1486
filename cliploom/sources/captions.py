"""Caption files read back: SRT, WebVTT and ASS to rows, as a table or as a stream of files.

Files come through Spark's text reader, one row a file, and are taken apart by built-in functions: any store that Spark
reads will do, folders named by column=value are columns whose filters skip files, and workers need no Python. A whole file
is one value; caption files are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times of a cue: hours are optional, a comma or a point goes before the milliseconds.
CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"
CUE = rf"(?:^|\n)[ \t]*{CLOCK}[ \t]+-->[ \t]+{CLOCK}[^\n]*(?:\n|$)"
ASS_CLOCK = r"^\s*(\d+):(\d{2}):(\d{2})[.:](\d{2})\s*$"


def _part(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found == "", F.lit("0")).otherwise(found).cast("long")


def _ms(text: Column, pattern: str, first: int, unit: int) -> Column:
    h, m, s, rest = (_part(text, pattern, first + k) for k in range(4))
    return ((h * 60 + m) * 60 + s) * 1000 + rest * unit


def _plain(body: Column) -> Column:
    """Line ends as \\n, without a byte order mark."""
    return F.regexp_replace(F.regexp_replace(body, "^﻿", ""), "\r\n?", "\n")


def cues(body: Column) -> Column:
    """Array of (start_ms, end_ms, text) of an SRT or WebVTT file; notes, styles and broken blocks are passed over."""
    blocks = F.filter(F.split(_plain(body), r"\n[ \t]*\n"), lambda b: b.rlike(CUE))
    text = lambda b: F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n?(.*)$", 1), r"\n+$", "")
    return F.transform(blocks, lambda b: F.struct(_ms(b, CUE, 1, 1).alias("start_ms"), _ms(b, CUE, 5, 1).alias("end_ms"), text(b).alias("text")))


def events(body: Column) -> Column:
    """Array of (start_ms, end_ms, text) of an ASS file, by the Format line of its events; override tags are left out, \\N is a line end."""
    lines = F.split(_plain(body), "\n")
    heads = F.filter(lines, lambda x: x.rlike(r"^Format:.*\bStart\b"))
    names = F.transform(F.split(F.regexp_replace(F.get(heads, F.lit(0)), "^Format:", ""), ","), lambda x: F.trim(x))
    fields = lambda x: F.split(F.regexp_replace(x, "^Dialogue:", ""), ",", -1)
    at = lambda x, name: F.get(fields(x), (F.array_position(names, name) - 1).cast("int"))
    rest = lambda x: F.array_join(F.slice(fields(x), F.size(names), F.greatest(F.size(fields(x)) - F.size(names) + 1, F.lit(0))), ",")
    text = lambda x: F.regexp_replace(F.regexp_replace(rest(x), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    told = F.filter(lines, lambda x: x.startswith("Dialogue:") & at(x, "Start").rlike(ASS_CLOCK) & at(x, "End").rlike(ASS_CLOCK))
    return F.transform(told, lambda x: F.struct(_ms(at(x, "Start"), ASS_CLOCK, 1, 10).alias("start_ms"), _ms(at(x, "End"), ASS_CLOCK, 1, 10).alias("end_ms"), text(x).alias("text")))


def read(spark: SparkSession, path: str, form: str, stream: bool = False, schema: str = "") -> DataFrame:
    """(file, cue, start_ms, end_ms, text, and columns of the folders): cues of all files of a form (srt, vtt, ass) under path, numbered from 0 in each file.

    As a stream, files are read once each as they come; `schema` then names the columns of the folders, as a stream does not look.
    """
    if form not in ("srt", "vtt", "ass"):
        raise ValueError(f"captions in the form {form!r}")
    reader = (spark.readStream if stream else spark.read).option("wholetext", True)
    if stream or schema:
        reader = reader.schema("value string" + (f", {schema}" if schema else ""))
    files = reader.format("text").load(path)
    folders = [c for c in files.columns if c != "value"]
    rows = files.select(F.col("_metadata.file_path").alias("file"), *folders, F.posexplode(events(F.col("value")) if form == "ass" else cues(F.col("value"))).alias("cue", "c"))
    return rows.select("file", *folders, "cue", "c.*")


def read_table(rows: DataFrame, form: str) -> DataFrame:
    """(video_id, cue, start_ms, end_ms, text): cues of caption files kept as rows (video_id, value) of a table."""
    if form not in ("srt", "vtt", "ass"):
        raise ValueError(f"captions in the form {form!r}")
    return rows.select("video_id", F.posexplode(events(F.col("value")) if form == "ass" else cues(F.col("value"))).alias("cue", "c")).select("video_id", "cue", "c.*")


def edited(sentences: DataFrame, cues: DataFrame) -> DataFrame:
    """sentences (video_id, sent_idx, start_ms, end_ms, text, ...) with times and texts of the cues (video_id, cue, ...) that were read back.

    The n-th cue of a video is its n-th sentence by start, end and sent_idx, as the writers have it; sentences without one stay.
    """
    order = F.struct("start_ms", "end_ms", "sent_idx")
    places = sentences.groupBy("video_id").agg(F.array_sort(F.collect_list(order)).alias("s")).select("video_id", F.posexplode("s").alias("cue", "s"))
    new = places.join(cues.select("video_id", "cue", F.struct("start_ms", "end_ms", "text").alias("new")), ["video_id", "cue"]).select("video_id", F.col("s.sent_idx").alias("sent_idx"), "new")
    rows = sentences.join(new, ["video_id", "sent_idx"], "left")
    return rows.select(*(F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) if c in ("start_ms", "end_ms", "text") else F.col(c) for c in sentences.columns))
