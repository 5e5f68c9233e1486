"""Sessions of a stream of late events: visits with no more than a gap between them, merged where a late row bridges two.

A session is told once the watermark has passed its end (append), or with every change (update); in update mode a session
that two others grew into is told with the earlier start, and the rows of both told before are to be replaced: `upserted`
keeps what holds now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import overlap_join

SESSIONS = "viewer long, start timestamp, end timestamp, n long, most double"


def sessions(visits: DataFrame, gap: str, late: str) -> DataFrame:
    """(viewer, start, end, n, most) of visits (viewer, at, value): end is `gap` after the last visit. Rows without viewer or time are ignored, and rows later than `late`."""
    known = visits.where("viewer is not null and at is not null").withWatermark("at", late)
    rows = known.groupBy(F.session_window("at", gap).alias("w"), "viewer").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return rows.select("viewer", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "most")


def run(visits: DataFrame, path: str, checkpoint: str, gap: str, late: str) -> None:
    """Append the sessions that are over to the Parquet folder `path`."""
    query = sessions(visits, gap, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def upserted(held: DataFrame, told: DataFrame) -> DataFrame:
    """Sessions that hold once those told in update mode have come: they take the place of all that they overlap.

    Both are (viewer, start, end, n, most); sessions of one viewer that are told together do not overlap.
    """
    ranged = lambda df: df.withColumns({"start_ms": F.unix_millis("start"), "end_ms": F.unix_millis("end")})
    gone = overlap_join(ranged(held), ranged(told), "viewer", 86_400_000).select("viewer", "start").distinct()
    return held.join(gone, ["viewer", "start"], "left_anti").unionByName(told.select(*held.columns))
