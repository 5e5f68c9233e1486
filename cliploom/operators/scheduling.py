"""Best clips of a video that don't overlap: weighted interval scheduling.

Clips that overlap, directly or over others, form islands; between islands there is silence, where a video can be cut
without cutting a clip. Each island is solved by itself, for every number of clips up to k; the answers of islands that
follow each other are then joined, FAN at a time, until one is left for each video. So a long video is many small tasks.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_importable
from ..storage import discard, stored

#: Islands joined in one step.
FAN = 64
#: A choice: (score, places of its clips in time order). More score is better, then what begins earlier.
Choice = tuple[float, tuple[int, ...]]


def better(a: Choice | None, b: Choice | None) -> Choice | None:
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-x[0], x[1]))


def solve(starts: list[int], ends: list[int], scores: list[float], k: int) -> list[Choice | None]:
    """The best choice of exactly 0, 1, ... k clips, which are in order of their starts; None where there are too few apart."""
    n = len(starts)
    after = [bisect_left(starts, ends[i], i + 1) for i in range(n)]
    best: list[list[Choice | None]] = [[(0.0, ())] + [None] * k for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(1, k + 1):
            rest = best[after[i]][j - 1]
            taken = rest and (scores[i] + rest[0], (i, *rest[1]))
            best[i][j] = better(taken, best[i + 1][j])
    return best[0]


def join(a: list[Choice | None], b: list[Choice | None], k: int) -> list[Choice | None]:
    """The best choices of two stretches, the second after the first; places already count over both."""
    out: list[Choice | None] = [None] * (k + 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b[: k + 1 - i]):
            if x is not None and y is not None:
                out[i + j] = better(out[i + j], (x[0] + y[0], x[1] + y[1]))
    return out


SOLVED = "video_id long, stretch long, n long, score double, places array<long>"


def _rows(video: int, stretch: int, choices: list[Choice | None]) -> pd.DataFrame:
    kept = [(video, stretch, n, c[0], list(c[1])) for n, c in enumerate(choices) if c is not None]
    return pd.DataFrame(kept, columns=["video_id", "stretch", "n", "score", "places"])


def _island(k: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        base = int(g["place"].iloc[0])
        found = solve(g["start_ms"].tolist(), g["end_ms"].tolist(), g["score"].tolist(), k)
        return _rows(int(g["video_id"].iloc[0]), int(g["island"].iloc[0]), [c and (c[0], tuple(base + p for p in c[1])) for c in found])

    return run


def _stretch(k: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        whole: list[Choice | None] = [(0.0, ())]
        for _, part in g.groupby("stretch", sort=True):
            choices: list[Choice | None] = [None] * (k + 1)
            for n, score, places in zip(part["n"], part["score"], part["places"], strict=True):
                choices[n] = (score, tuple(int(p) for p in places))
            whole = join(whole, choices, k)
        return _rows(int(g["video_id"].iloc[0]), int(g["into"].iloc[0]), whole)

    return run


def best_apart(clips: DataFrame, k: int, fan: int = FAN) -> DataFrame:
    """The rows of up to k clips (video_id, moment_id, start_ms, end_ms, score) of each video that don't overlap and score most in all.

    Of equal totals fewer clips are chosen, then those that come first (by start, end, moment_id). Ranges are half-open, so
    clips may touch; a clip of no length overlaps those that begin before it and end after it. Clips with null times or scores, or that score
    nothing or less, are never chosen. The order of the whole of a video is made in one sort for each video.
    """
    ensure_importable(clips.sparkSession)
    order = W.partitionBy("video_id").orderBy("start_ms", "end_ms", "moment_id")
    rows = clips.where("start_ms <= end_ms and score > 0 and video_id is not null")
    until = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"place": F.row_number().over(order).cast("long") - 1, "_new": F.coalesce((F.col("start_ms") >= until).cast("long"), F.lit(0))})
    rows = stored(rows.withColumn("island", F.sum("_new").over(order)).drop("_new"), "clips-placed")
    part = rows.select(F.col("video_id").cast("long").alias("video_id"), "island", "place", "start_ms", "end_ms", F.col("score").cast("double").alias("score"))
    now = stored(part.groupBy("video_id", "island").applyInPandas(_island(k), SOLVED), "clips-solved")
    while not now.where("stretch > 0").isEmpty():
        after = now.withColumn("into", F.floor(F.col("stretch") / fan)).groupBy("video_id", "into").applyInPandas(_stretch(k), SOLVED)
        after = stored(after, "clips-solved")
        discard(now)
        now = after
    best = now.groupBy("video_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "n", "places")).alias("b"))
    chosen = best.select("video_id", F.explode("b.places").alias("place"))
    return rows.join(chosen, ["video_id", "place"]).select(*clips.columns)
