"""Caption times from whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(ms: Column) -> tuple[Column, Column, Column]:
    return F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours grow beyond two digits."""
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(ms), ms % 1000)


def vtt_time(ms: Column) -> Column:
    """HH:MM:SS.mmm."""
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(ms), ms % 1000)


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc; centiseconds are cut, not rounded."""
    return F.format_string("%d:%02d:%02d.%02d", *_parts(ms), F.floor(ms / 10) % 100)


def day_ms(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 of a timestamp without zone, whatever the session's zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400000 + F.hour(ts) * 3600000 + F.minute(ts) * 60000 + F.floor(F.date_part(F.lit("SECONDS"), ts) * 1000).cast("long")
