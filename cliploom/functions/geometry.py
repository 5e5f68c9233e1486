"""Upright 9:16 crop boxes in whole pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_size(width: Column, height: Column) -> tuple[Column, Column]:
    """The largest 9:16 box, with even sides."""
    w = F.least(width, F.floor(height * 9 / 16))
    h = F.least(height, F.floor(width * 16 / 9))
    return (w - w % 2).cast("long"), (h - h % 2).cast("long")


def crop_box(width: Column, height: Column) -> Column:
    """Centred: struct of x, y, w, h."""
    w, h = crop_size(width, height)
    return F.struct(F.floor((width - w) / 2).alias("x"), F.floor((height - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def crop_follow(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Centred on a face, kept inside the frame: struct of x, y, w, h."""
    w, h = crop_size(width, height)
    inside = lambda c, side, most: F.greatest(F.lit(0), F.least(most - side, F.floor(c - side / 2))).cast("long")
    return F.struct(inside(cx, w, width).alias("x"), inside(cy, h, height).alias("y"), w.alias("w"), h.alias("h"))
