"""Box arithmetic as column expressions; everything stays in generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from skytriage.constants import BUCKETS


class Box(NamedTuple):
    """Four columns. Their meaning (corners, corner+size, centre+size) is the caller's."""

    a: Column
    b: Column
    c: Column
    d: Column


def corners(prefix: str = "", suffix: str = "") -> Box:
    """The canonical ``x1, y1, x2, y2`` columns, optionally decorated."""
    return Box(*(F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2")))


def field_box(struct: Column) -> Box:
    return Box(struct["x1"], struct["y1"], struct["x2"], struct["y2"])


def named(box: Box, names=("x1", "y1", "x2", "y2")) -> list[Column]:
    return [c.alias(n) for c, n in zip(box, names)]


def is_valid(box: Box) -> Column:
    """Finite corners with positive extent; null never counts as valid."""
    finite = F.lit(True)
    for c in box:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite & (box.c > box.a) & (box.d > box.b)


def checked(box: Box) -> Box:
    """The same corners, failing the job on the first invalid box instead of clamping."""
    bad = F.raise_error(F.concat(F.lit("invalid box: "), F.concat_ws(",", *box))).cast("double")
    return Box(F.when(is_valid(box), box.a).otherwise(bad), box.b, box.c, box.d)


def xywh_to_xyxy(box: Box) -> Box:
    return Box(box.a, box.b, box.a + box.c, box.b + box.d)


def xyxy_to_xywh(box: Box) -> Box:
    return Box(box.a, box.b, box.c - box.a, box.d - box.b)


def cxcywh_to_xyxy(box: Box) -> Box:
    half_w, half_h = box.c / 2, box.d / 2
    return Box(box.a - half_w, box.b - half_h, box.a + half_w, box.b + half_h)


def xyxy_to_cxcywh(box: Box) -> Box:
    return Box((box.a + box.c) / 2, (box.b + box.d) / 2, box.c - box.a, box.d - box.b)


def _size(value, what: str) -> Column:
    col = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(col > 0, col).otherwise(
        F.raise_error(F.lit(f"image {what} must be positive")).cast("double"))


def normalise(box: Box, width, height) -> Box:
    w, h = _size(width, "width"), _size(height, "height")
    return Box(box.a / w, box.b / h, box.c / w, box.d / h)


def denormalise(box: Box, width, height) -> Box:
    w, h = _size(width, "width"), _size(height, "height")
    return Box(box.a * w, box.b * h, box.c * w, box.d * h)


def tile_to_frame(box: Box, offset_x: Column, offset_y: Column) -> Box:
    return Box(box.a + offset_x, box.b + offset_y, box.c + offset_x, box.d + offset_y)


def frame_to_tile(box: Box, offset_x: Column, offset_y: Column) -> Box:
    return Box(box.a - offset_x, box.b - offset_y, box.c - offset_x, box.d - offset_y)


def area(box: Box) -> Column:
    return (box.c - box.a) * (box.d - box.b)


def pixels_on_target(box: Box) -> Column:
    return F.sqrt(area(box))


def size_bucket(px: Column) -> Column:
    """Bucket label of a pixels-on-target value; a value on an edge belongs above it."""
    out = F.when(px < BUCKETS[0][2], BUCKETS[0][0])
    for name, _, high in BUCKETS[1:-1]:
        out = out.when(px < high, name)
    return F.when(px.isNotNull(), out.otherwise(BUCKETS[-1][0]))


def iou(p: Box, q: Box) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(p.c, q.c) - F.greatest(p.a, q.a), zero)
    h = F.greatest(F.least(p.d, q.d) - F.greatest(p.b, q.b), zero)
    inter = w * h
    return inter / (area(p) + area(q) - inter)


def centre_distance(p: Box, q: Box) -> Column:
    dx = (p.a + p.c) / 2 - (q.a + q.c) / 2
    dy = (p.b + p.d) / 2 - (q.b + q.d) / 2
    return F.sqrt(dx * dx + dy * dy)


def affinity(track: Box, det: Box, iou_threshold: float = 0.3, factor: float = 2.0) -> Column:
    """Association strength in [0, 1]; zero means the pair may not be linked.

    Overlap at or above the threshold counts as itself. Below it, centre distance
    measured in multiples of the track's own size gives a weaker value that can
    never reach the threshold.
    """
    overlap = iou(track, det)
    strong = F.when(overlap >= iou_threshold, overlap).otherwise(F.lit(0.0))
    if factor <= 0:
        return strong
    reach = F.lit(factor) * F.greatest(pixels_on_target(track), F.lit(1e-6))
    near = F.greatest(F.least(F.lit(1.0) - centre_distance(track, det) / reach, F.lit(1.0)), F.lit(0.0))
    return F.greatest(strong, near * F.lit(iou_threshold) * F.lit(0.999))
