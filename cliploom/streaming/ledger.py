"""A queue whose jobs take effect once: results and a ledger of finished batches, retries with growing waits, recovery.

Jobs of a micro-batch are placed by arrival over the whole batch and run on the executors, each task its jobs in order. A job
that fails is tried again after a wait that doubles, `most` times in all; then it is noted as dead and the queue goes on.
Results are written to a folder named by the batch, and only then is the batch entered in the ledger, by creating a file
that must not be there. The stream's checkpoint comes after that. So whatever is lost, the same batch comes again: if it is
in the ledger it is passed over, if not its folder is dropped and it runs again; readers see only batches in the ledger.

A job itself may then run twice, so `run` gets the job's key, by which what it does outside can be made to count once. A job
that is entered again once it is in the ledger, or twice in a batch, runs only once (the first by arrival counts).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ranking import numbered
from ..session import ensure_importable
from ..storage import discard, stored

RESULTS = "job_id long, source string, place long, status string, attempts long, error string"
#: Most attempts, and seconds before the second one.
MOST, WAIT = 3, 1.0


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, folder: str, batch: int) -> bool:
    fs, where = _path(spark, f"{folder}/ledger/{batch}")
    return fs.exists(where)


def commit(spark: SparkSession, folder: str, batch: int) -> None:
    """Enter a batch; an error if it is there already."""
    fs, where = _path(spark, f"{folder}/ledger/{batch}")
    entry = fs.create(where, False)
    entry.writeBytes(str(batch))  # Spark passes over empty files
    entry.close()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the batches in the ledger."""
    fs, where = _path(spark, f"{folder}/ledger")
    if not fs.exists(where):
        return spark.createDataFrame([], RESULTS)
    entered = spark.read.format("binaryFile").load(f"{folder}/ledger").select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("long").alias("batch"))
    rows = spark.read.schema(f"{RESULTS}, batch long").parquet(f"{folder}/results")
    return rows.join(F.broadcast(entered), "batch", "left_semi").drop("batch")  # a number for each batch


def _tried(run: Callable[[dict, str], None], most: int, wait: float):
    def jobs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                status, error, n = "dead", None, 0
                while n < most and status == "dead":
                    if n:
                        time.sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        run({**job, "attempt": n}, f"job-{job['job_id']}")
                        status, error = "done", None
                    except Exception as e:  # noqa: BLE001  a job may fail in any way; the queue goes on
                        error = f"{type(e).__name__}: {e}"
                out.append((job["job_id"], job["source"], job["place"], status, n, error))
            yield pd.DataFrame(out, columns=["job_id", "source", "place", "status", "attempts", "error"])

    return jobs


def take(batch: DataFrame, number: int, folder: str, run: Callable[[dict, str], None], most: int = MOST, wait: float = WAIT) -> None:
    """Run the jobs of one micro-batch, unless the ledger has it."""
    spark = batch.sparkSession
    ensure_importable(spark)
    if committed(spark, folder, number):
        return
    fs, where = _path(spark, f"{folder}/results/batch={number}")
    fs.delete(where, True)  # what a lost attempt left
    before = results(spark, folder)
    first = batch.where("job_id is not null").groupBy("job_id").agg(F.min(F.struct("submitted_at", "source")).alias("x")).select("job_id", "x.*")
    new = stored(first.join(before.select("job_id"), "job_id", "left_anti"), "jobs-new")
    placed = numbered(new, [F.col("submitted_at").asc_nulls_first(), "job_id"], "place").withColumn("place", F.col("place") + before.count() + 1)
    placed = placed.select("job_id", "source", "place").repartitionByRange("place").sortWithinPartitions("place")
    placed.mapInPandas(_tried(run, most, wait), RESULTS).write.parquet(f"{folder}/results/batch={number}")
    commit(spark, folder, number)
    discard(new)


def drain(spark: SparkSession, path: str, folder: str, checkpoint: str, run: Callable[[dict, str], None], most: int = MOST, wait: float = WAIT, files: int | None = None) -> None:
    """Run all jobs (JSON lines of schemas.JOBS under path) that there are now, up to `files` files in a batch; the next call goes on from there."""
    stream = spark.readStream.schema(schemas.JOBS)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).json(path)
    query = stream.writeStream.foreachBatch(lambda rows, number: take(rows, number, folder, run, most, wait)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
