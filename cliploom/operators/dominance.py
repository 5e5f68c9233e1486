"""Rows that others exceed in one measure while falling short in another, counted without comparing pairs.

Two numbers place each row: x by the first measure, y by the second, both over the whole table and without ties. What counts
for a row is how many rows have a smaller x and a smaller y. Both axes are cut into blocks of BLOCK places. Rows of one x
block are counted against each other, so are rows of one y block that lie in earlier x blocks, each in one task of exactly
BLOCK rows, whatever values they hold; all rows of earlier x and y blocks are a prefix sum over the grid of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_importable
from ..storage import stored
from .ranking import numbered

BLOCK = 1 << 16
#: Rows compared with each other at once.
CHUNK = 512


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value how many earlier ones are smaller: by a sorted list of all before the chunk, and pair by pair within it."""
    out, seen = np.zeros(len(values), np.int64), values[:0]
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        out[at : at + CHUNK] = np.searchsorted(seen, part, "left") + np.tril(part[None, :] < part[:, None], -1).sum(1)
        seen = np.sort(np.concatenate((seen, part)), kind="stable")
    return out


def _counted(order: str, value: str):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order)
        return pd.DataFrame({"x": block["x"].to_numpy(), "n": smaller_before(block[value].to_numpy())})

    return run


def exceeded(rows: DataFrame, more: str, less: str, key: str, block: int = BLOCK) -> DataFrame:
    """rows with n_above: how many rows have more of `more` and less of `less`. Rows in which either is null are left out; key orders equal rows."""
    ensure_importable(rows.sparkSession)
    known = rows.where(F.col(more).isNotNull() & F.col(less).isNotNull())
    # among rows equal in one measure none counts for another: they stand in falling order of the other measure
    placed = stored(numbered(known, [F.desc(more), F.desc(less), F.col(key)], "x"), "placed-x")
    placed = stored(numbered(placed, [F.asc(less), F.desc("x")], "y"), "placed-xy")
    cut = placed.withColumns({"xb": F.floor(F.col("x") / block), "yb": F.floor(F.col("y") / block)})
    own = cut.select("x", "y", "xb").groupBy("xb").applyInPandas(_counted("x", "y"), "x long, n long")
    across = cut.select("x", "y", "xb", "yb").groupBy("yb").applyInPandas(_counted("y", "xb"), "x long, n long")
    blocks = max(1, -(-placed.count() // block))
    grid = rows.sparkSession.range(blocks).select(F.col("id").alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("yb"))
    grid = grid.join(cut.groupBy("xb", "yb").count(), ["xb", "yb"], "left").na.fill(0, ["count"])
    before = lambda by, order: W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("left", F.coalesce(F.sum("count").over(before("yb", "xb")), F.lit(0)))
    grid = grid.withColumn("earlier", F.coalesce(F.sum("left").over(before("xb", "yb")), F.lit(0))).select("xb", "yb", "earlier")
    counts = own.union(across).groupBy("x").agg(F.sum("n").alias("n"))
    out = cut.join(counts, "x").join(grid, ["xb", "yb"])
    return out.select(*rows.columns, (F.col("n") + F.col("earlier")).alias("n_above"))
