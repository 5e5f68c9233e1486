"""Streams over the driver's tables: states of jobs, a queue with a ledger, sessions; and vector search, which has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..sources import standins as S
from ..storage import fresh_folder
from ..streaming import jobs, ledger, sessions

#: Event types as what happens to a job.
KINDS = {"signup": "submitted", "view": "started", "click": "beat", "purchase": "done", "error": "failed"}
#: A moment after all events, by which the watermark passes them.
END = "2100-01-01 00:00:00"
NEIGHBOURS = 10


def _as_files(spark: SparkSession, rows: DataFrame, last: str, name: str, files: int = 4) -> DataFrame:
    """rows as a stream of files, two in a micro-batch, then one more row (the SQL of a struct's fields)."""
    path = fresh_folder(spark, name)
    rows.repartition(files).write.parquet(path)
    spark.range(1).selectExpr(last).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def job_changes(spark: SparkSession, d: str) -> DataFrame:
    """Users stand in for jobs, the types of their events for what happens to them."""
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in KINDS.items()))
    rows = S.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    path = fresh_folder(spark, "job-changes")
    end = f"inline(array(struct(-1L AS job_id, timestamp '{END}' AS at, 'end' AS kind)))"
    jobs.run(_as_files(spark, rows, end, "job-events"), f"{path}/out", f"{path}/checkpoint", late="60 days")
    return spark.read.schema(jobs.CHANGES).parquet(f"{path}/out").select("job_id", F.unix_millis("at").alias("at_ms"), "status", "attempt")


def _order(job: dict, key: str) -> None:
    """Every tenth job fails once, every 97th always."""
    if job["job_id"] % 97 == 0 or job["job_id"] % 10 == 0 and job["attempt"] == 1:
        raise RuntimeError("as told")


def queue_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for jobs."""
    path = fresh_folder(spark, "queue")
    rows = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("submitted_at"))
    rows.repartition(4).write.json(f"{path}/jobs")
    ledger.drain(spark, f"{path}/jobs", path, f"{path}/checkpoint", _order, wait=0.0)
    return ledger.results(spark, path).select("job_id", "source", "place", "status", "attempts")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Views of a user as visits, in sessions with no more than a day between them."""
    rows = S.read(spark, d, "events").select(F.col("user_id").alias("viewer"), F.col("ts").cast("timestamp").alias("at"), "value")
    path = fresh_folder(spark, "sessions")
    end = f"inline(array(struct(-1L AS viewer, timestamp '{END}' AS at, 0D AS value)))"
    sessions.run(_as_files(spark, rows, end, "session-events"), f"{path}/out", f"{path}/checkpoint", "24 hours", "60 days")
    return spark.read.schema(sessions.SESSIONS).parquet(f"{path}/out").select("viewer", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", "most")


def vector_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of every twentieth vector among all."""
    rows, path = S.read(spark, d, "embeddings"), fresh_folder(spark, "vectors")
    vectors.write_index(rows, path)
    queries = vectors.usable(rows.where("vec_id % 20 = 0")).withColumnRenamed("vec_id", "query_id")  # in this order: unit() is dear
    return vectors.read_index(spark, path, NEIGHBOURS).search(queries, NEIGHBOURS)


QUERIES = [job_changes, queue_ledger, user_sessions]
WITHOUT_SQL = [vector_neighbors]

SQL = {
    "job_changes": f"""WITH RECURSIVE m AS (
  SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind FROM events
),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in jobs.ORDER.items())} END) AS k FROM m WHERE kind IS NOT NULL AND job_id IS NOT NULL),
s(job_id, k, status, attempt, due, told) AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(ms BIGINT, status VARCHAR, attempt BIGINT)[]) FROM e
  UNION ALL
  SELECT job_id, k, CASE WHEN enters THEN 'queued' WHEN starts THEN 'running' WHEN ends THEN 'done' WHEN fails AND attempt < {jobs.MOST} THEN 'queued' WHEN fails THEN 'dead' ELSE st END,
    CASE WHEN enters THEN 0 WHEN starts THEN attempt + 1 ELSE attempt END, CASE WHEN starts OR beats THEN ms + {jobs.STALL} ELSE due END,
    list_concat(CASE WHEN late THEN [{{'ms': due, 'status': 'stalled', 'attempt': attempt}}, {{'ms': due, 'status': st, 'attempt': attempt}}] ELSE [] END,
      CASE WHEN enters THEN [{{'ms': ms, 'status': 'queued', 'attempt': 0}}] WHEN starts THEN [{{'ms': ms, 'status': 'running', 'attempt': attempt + 1}}] WHEN ends THEN [{{'ms': ms, 'status': 'done', 'attempt': attempt}}]
        WHEN fails THEN [{{'ms': ms, 'status': 'failed', 'attempt': attempt}}, {{'ms': ms, 'status': CASE WHEN attempt < {jobs.MOST} THEN 'queued' ELSE 'dead' END, 'attempt': attempt}}] ELSE [] END)
  FROM (
    SELECT *, kind = 'submitted' AND st IN ('', 'done', 'dead') AS enters, kind = 'started' AND st = 'queued' AS starts, kind = 'beat' AND st = 'running' AS beats, kind = 'done' AND st = 'running' AS ends, kind = 'failed' AND st = 'running' AS fails
    FROM (
      SELECT s.job_id, e.k, attempt, due, ms, kind, status = 'running' AND due <= ms AS late, CASE WHEN status = 'running' AND due <= ms THEN CASE WHEN attempt < {jobs.MOST} THEN 'queued' ELSE 'dead' END ELSE status END AS st
      FROM s JOIN e ON e.job_id = s.job_id AND e.k = s.k + 1
    )
  )
),
last AS (SELECT job_id, arg_max(status, k) AS status, arg_max(attempt, k) AS attempt, arg_max(due, k) AS due FROM s GROUP BY job_id),
told AS (
  SELECT job_id, unnest(told) AS t FROM s
  UNION ALL SELECT job_id, unnest([{{'ms': due, 'status': 'stalled', 'attempt': attempt}}, {{'ms': due, 'status': CASE WHEN attempt < {jobs.MOST} THEN 'queued' ELSE 'dead' END, 'attempt': attempt}}]) FROM last WHERE status = 'running'
)
SELECT job_id, t.ms AS at_ms, t.status AS status, t.attempt AS attempt FROM told""",
    "queue_ledger": f"""SELECT o_orderkey AS job_id, o_orderpriority AS source, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place,
  CASE WHEN o_orderkey % 97 = 0 THEN 'dead' ELSE 'done' END AS status, CAST(CASE WHEN o_orderkey % 97 = 0 THEN {ledger.MOST} WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM orders""",
    "user_sessions": """WITH e AS (SELECT user_id AS viewer, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY viewer ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT viewer, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 24 HOURS) // 1000 AS end_ms, count(*) AS n, max(value) AS most FROM s GROUP BY viewer, k""",
}
