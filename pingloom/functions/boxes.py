"""Column expressions on boxes. Every name says its convention: xyxy (corners) or xywh (corner and size)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def named(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def fields(struct: Column, names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(struct[n] for n in names)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> tuple[Column, Column]:
    """Signed overlap along both axes; positive where boxes share more than an edge."""
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of xyxy boxes; 0 without a positive overlap."""
    w, h = overlap(a, b)
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h / (area(a) + area(b) - w * h))


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def to_xyxy(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def contains_centre(box: Box, other: Box) -> Column:
    cx, cy = (other[0] + other[2]) / 2, (other[1] + other[3]) / 2
    return cx.between(box[0], box[2]) & cy.between(box[1], box[3])


def tile_origins(length: Column, size: int, stride: int) -> Column:
    """Origins 0, stride, ... below length; a single 0 if the length fits a tile."""
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length.cast("int") - 1, F.lit(stride)))
