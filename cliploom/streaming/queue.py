"""A queue of jobs: files of job rows are taken in order of arrival and run one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def in_order(jobs: DataFrame) -> DataFrame:
    """Jobs by arrival, then id."""
    return jobs.orderBy("submitted_at", "job_id")


def drain(spark: SparkSession, path: str, checkpoint: str, run: Callable[[Row], None]) -> int:
    """Run every job not yet run under this checkpoint, in order of arrival; a job that fails stops the queue. Returns how many ran."""
    done = 0

    def batch(rows: DataFrame, _: int) -> None:
        nonlocal done
        for job in in_order(rows).toLocalIterator():  # jobs are entered by hand: few, and each is long
            run(job)
            done += 1

    stream = spark.readStream.schema(schemas.JOBS).json(path)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done


def views_by_hour(snapshots: DataFrame, late: str = "2 hours") -> DataFrame:
    """Streamed view counts: the most seen of each post in each hour, late rows within `late`. Beyond the data model's needs."""
    ts = F.col("last_checked_at").cast("timestamp")  # watermarks refuse timestamps without zone
    return snapshots.withColumn("last_checked_at", ts).withWatermark("last_checked_at", late).groupBy(F.window("last_checked_at", "1 hour"), "id").agg(F.max("views_count").alias("views_count"))
