"""Rankings and windows with complete orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def top(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """Up to k rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def smooth(rows: DataFrame, key: str, order: list[str], value: str, reach: int) -> Column:
    """Centred moving average over `reach` rows on either side."""
    return F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-reach, reach))


def parts(rows: DataFrame, key: list[str], order: list[str], length: Column, most: int) -> DataFrame:
    """Rows with part and n_parts: a new part begins with the row before which `most` or a multiple of it has run."""
    w = W.partitionBy(*key).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parted = rows.withColumn("_p", F.floor(before / most))
    dense = F.dense_rank().over(W.partitionBy(*key).orderBy("_p")).cast("long")
    return parted.withColumn("part", dense).withColumn("n_parts", F.max("part").over(W.partitionBy(*key))).drop("_p")


def numbered_speakers(sentences: DataFrame) -> DataFrame:
    """(video_id, speaker, label): Speaker 1, 2, ... by first appearance."""
    first = sentences.groupBy("video_id", "speaker").agg(F.min("sent_idx").alias("first"))
    rank = F.dense_rank().over(W.partitionBy("video_id").orderBy("first", "speaker"))
    return first.select("video_id", "speaker", F.concat(F.lit("Speaker "), rank.cast("string")).alias("label"))
