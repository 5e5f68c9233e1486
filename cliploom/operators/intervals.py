"""Joins on half-open time ranges [start, end) within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _buckets(start: str, end: str, width: int) -> Column:
    """Buckets that a range of positive length touches."""
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 3_600_000) -> DataFrame:
    """Pairs of equal key whose ranges overlap; columns of both, those of `right` prefixed r_.

    Ranges of no length or null ends overlap nothing. Both sides are cut into time buckets, so that a key with many ranges
    is spread over tasks; a pair counts in the bucket where its overlap begins.
    """
    a = left.where("start_ms < end_ms").withColumn("_b", _buckets("start_ms", "end_ms", width))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).where("r_start_ms < r_end_ms").withColumn("_rb", _buckets("r_start_ms", "r_end_ms", width))
    pairs = a.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & (F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms")))
    return pairs.where(F.col("_b") == F.floor(F.greatest("start_ms", "r_start_ms") / width)).drop("_b", "_rb")


def overlap_ms() -> Column:
    return F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")


def assign_largest(left: DataFrame, right: DataFrame, key: str, id_: str, label: str, width: int = 3_600_000) -> DataFrame:
    """(id_, label): for each row of left the label of the range of right that overlaps it most, then begins first, then sorts first; null without any."""
    pairs = overlap_join(left.select(key, id_, "start_ms", "end_ms"), right.select(key, label, "start_ms", "end_ms"), key, width)
    best = pairs.groupBy(id_).agg(F.min_by(f"r_{label}", F.struct(-overlap_ms(), "r_start_ms", f"r_{label}")).alias(label))
    return left.select(id_).join(best, id_, "left")


def covering(points: DataFrame, ranges: DataFrame, key: str, id_: str, label: str, width: int = 3_600_000) -> DataFrame:
    """(id_, label): the latest-begun range of equal key that holds the point ts_ms; null without any."""
    spans = points.select(key, id_, F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 1).alias("end_ms"))
    pairs = overlap_join(spans, ranges.select(key, label, "start_ms", "end_ms"), key, width)
    best = pairs.groupBy(id_).agg(F.max_by(f"r_{label}", F.struct("r_start_ms", f"r_{label}")).alias(label))
    return points.select(id_).join(best, id_, "left")


def asof(points: DataFrame, ranges: DataFrame, key: str, id_: str, label: str, width: int | None = None) -> DataFrame:
    """(id_, label, since_ms): the last range of equal key that begins at or before ts_ms; of equal begins the greatest label.

    One pass over both sides merged in time order, no pairs; a key is one task. With `width` time is cut every so many ms,
    so that a key that goes on for ever is spread over tasks: within a cut rows are merged, and what holds at its start is
    carried over from the cuts before it, of which each key has one row. That is one more shuffle, for keys of more rows
    than a task can take. Points without time or key have no label.
    """
    cut = F.floor(F.col("t") / width) if width else F.lit(0).cast("long")
    a = points.select(key, F.col("ts_ms").alias("t"), F.lit(1).alias("kind"), F.col(id_).alias("id"), F.lit(None).cast(ranges.schema[label].dataType).alias("label"))
    b = ranges.where(F.col("start_ms").isNotNull() & F.col(key).isNotNull()).select(key, F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema[id_].dataType).alias("id"), F.col(label).alias("label"))
    rows = a.unionByName(b).withColumn("cut", cut)
    begun = F.when(F.col("kind") == 0, F.struct("t", "label"))
    within = W.partitionBy(key, *(["cut"] if width else [])).orderBy("t", "kind", "label", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = rows.withColumn("s", F.last(begun, ignorenulls=True).over(within)).where("kind = 1")
    if width is None:
        return merged.select(F.col("id").alias(id_), F.col("s.label").alias(label), F.col("s.t").alias("since_ms"))
    earlier = W.partitionBy(key).orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    cuts = rows.groupBy(key, "cut").agg(F.max(begun).alias("last")).withColumn("carried", F.max("last").over(earlier)).drop("last")
    out = merged.alias("m").join(cuts.alias("c"), F.expr(f"m.`{key}` = c.`{key}` and m.cut = c.cut"), "left").select("m.id", F.coalesce("m.s", "c.carried").alias("s"))
    return out.select(F.col("id").alias(id_), F.col("s.label").alias(label), F.col("s.t").alias("since_ms"))
