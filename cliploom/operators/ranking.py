"""Numbers and ranks over a whole table in one order, without a task that sees all of it.

Rows are dealt by ranges of the order and sorted in their range. A row's place is its place in the range plus the rows of
all earlier ranges: one number for each range, so offsets are as many as there are partitions and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from ..storage import stored

#: Bits of monotonically_increasing_id that count within a partition.
LOCAL = 33


def _offsets(sums: list[tuple[int, int]], name: str, df: DataFrame) -> DataFrame:
    """(_part, name): the sum over earlier ranges, one row for each range."""
    rows, before = [], 0
    for part, x in sorted(sums):
        rows.append((part, before))
        before += x
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"_part long, {name} long"))


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """rows with their number from 0 in `order`, which must tell rows apart (rows that agree in it are numbered in any order).

    A table that holds one value in a third of its rows is split like any other as long as the order goes on to a column
    that differs. An empty table gives no rows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "numbered")
    counts = dealt.groupBy(F.shiftright("_at", LOCAL).alias("_part")).count().collect()  # a row for each partition
    offsets = _offsets([tuple(r) for r in counts], "_before", rows)
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL) - 1))
    return dealt.withColumn("_part", F.shiftright("_at", LOCAL)).join(offsets, "_part").withColumn(name, local + F.col("_before")).drop("_at", "_part", "_before")


def _summed(amount: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = pc.fill_null(batch.column(batch.schema.get_field_index(amount)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(own)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - own)], [*batch.schema.names, name])

    return run


def running(rows: DataFrame, order: list[str | Column], amount: str, name: str = "before") -> DataFrame:
    """rows with the sum of the whole-number column `amount` over all earlier rows in `order`; null counts as 0."""
    ensure_importable(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    dealt = stored(dealt.mapInArrow(_summed(amount, name), f"{kinds}, `{name}` long"), "running")
    sums = dealt.groupBy("_part").agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long")).collect()  # a row for each partition
    offsets = _offsets([tuple(r) for r in sums], "_before", rows)
    return dealt.join(offsets, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def ranks(rows: DataFrame, value: str, ties: list[str], buckets: int = 4, descending: bool = False) -> DataFrame:
    """rows with number (from 1), rank, dense_rank, percent_rank, cume_dist and ntile over the whole table by `value`, then `ties`.

    Equal values share rank, dense_rank, percent_rank and cume_dist; nulls come first ascending and last descending. Ranks
    are made on the distinct values, each with its count, so that a value on both sides of a border of ranges is no
    special case; rows meet them by value, where the adaptive plan splits a value that most rows hold.
    """
    order = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_first()
    values = running(rows.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n")), [order], "_n", "_first")
    values = numbered(values, [order], "_dense")
    own = numbered(rows.withColumn("_value", F.col(value)), [order, *ties], "number").withColumn("number", F.col("number") + 1)
    total = rows.count()
    out = own.join(values.withColumnRenamed("_value", "_other"), F.expr("_value <=> _other"))
    small, large = divmod(total, buckets)
    place, wide = F.col("number") - 1, F.lit(large * (small + 1))
    tile = F.when(place < wide, F.floor(place / F.lit(small + 1))).otherwise(large + F.floor((place - wide) / F.lit(max(small, 1)))) + 1
    return out.select(
        *(F.col(c) for c in rows.columns), "number", (F.col("_first") + 1).alias("rank"), (F.col("_dense") + 1).alias("dense_rank"),
        (F.col("_first") / F.lit(max(total - 1, 1))).alias("percent_rank"), ((F.col("_first") + F.col("_n")) / F.lit(max(total, 1))).alias("cume_dist"), tile.cast("long").alias("ntile"),
    )
