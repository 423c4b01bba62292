"""Cells that let overlapping boxes meet on an equi-join key.

Every box has one home cell, on the grid level of its own size. A box probes the home
cells of every box that could overlap it with at least the given IoU: sizes then differ
by at most a factor 1/IoU, so a few levels are enough and the number of probes does not
depend on the size of the box or of the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skytriage.functions.geometry import Box


def _level(side: Column) -> Column:
    return F.floor(F.log2(side)).cast("int")


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), (level + 2).cast("double"))


def home_cell(box: Box) -> Column:
    level = _level(F.greatest(box.c - box.a, box.d - box.b))
    size = _cell_size(level)
    return F.struct(
        level.alias("level"),
        F.floor((box.a + box.c) / 2 / size).alias("ix"),
        F.floor((box.b + box.d) / 2 / size).alias("iy"),
    )


def probe_cells(box: Box, min_iou: float) -> Column:
    """All home cells in which a box with IoU >= ``min_iou`` can have its centre."""
    w, h = box.c - box.a, box.d - box.b
    cx, cy = (box.a + box.c) / 2, (box.b + box.d) / 2
    side = F.greatest(w, h)
    spread = max(1.0 - min_iou, 0.5 / min_iou - 0.5)

    def cells_on(level: Column) -> Column:
        size = _cell_size(level)
        other = F.pow(F.lit(2.0), level.cast("double"))
        reach_x = F.least(w * spread, w / 2 + other)
        reach_y = F.least(h * spread, h / 2 + other)

        def span(centre: Column, reach: Column) -> Column:
            return F.sequence(F.floor((centre - reach) / size), F.floor((centre + reach) / size))

        return F.flatten(F.transform(span(cx, reach_x), lambda ix: F.transform(
            span(cy, reach_y),
            lambda iy: F.struct(level.alias("level"), ix.alias("ix"), iy.alias("iy")))))

    # A hair of slack keeps pairs that meet the IoU exactly on a power of two.
    low = F.floor(F.log2(side) + math.log2(min_iou) - 1e-9).cast("int")
    high = F.floor(F.log2(side) - math.log2(min_iou) + 1e-9).cast("int")
    return F.flatten(F.transform(F.sequence(low, high), cells_on))


def near_level(reach: Column) -> Column:
    """Grid level (cells of 64, 256, ... px) on which a search radius spans few cells."""
    raw = F.ceil(F.log2(F.greatest(reach, F.lit(1.0)) / 64.0) / 2)
    return F.greatest(F.lit(0), F.least(raw, F.lit(NEAR_LEVELS - 1))).cast("int")


NEAR_LEVELS = 5


def near_size(level: Column) -> Column:
    return F.lit(64.0) * F.pow(F.lit(4.0), level.cast("double"))


def near_cells(cx: Column, cy: Column) -> Column:
    """The cell of a point on every level."""
    levels = F.array(*[F.lit(i) for i in range(NEAR_LEVELS)])
    return F.transform(levels, lambda lv: F.struct(
        lv.alias("level"), F.floor(cx / near_size(lv)).alias("ix"), F.floor(cy / near_size(lv)).alias("iy")))


def near_probes(cx: Column, cy: Column, reach: Column) -> Column:
    """Cells, on the level fitting ``reach``, that hold every point within it."""
    level = near_level(reach)
    size = near_size(level)

    def span(centre: Column) -> Column:
        return F.sequence(F.floor((centre - reach) / size), F.floor((centre + reach) / size))

    return F.flatten(F.transform(span(cx), lambda ix: F.transform(
        span(cy), lambda iy: F.struct(level.alias("level"), ix.alias("ix"), iy.alias("iy")))))
