"""Rectangle arithmetic (F6, F7) and the rectangles of the title block."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "x0 y0 x1 y1")


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{n}{suffix}") for n in Box._fields))


def _intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return w * h


def overlap_share(a: Box, b: Box) -> Column:
    """Intersection over the area of `a`, which counts as 1 at least."""
    return _intersection(a, b) / F.greatest(F.lit(1.0), (a.x1 - a.x0) * (a.y1 - a.y0))


def iou(a: Box, b: Box) -> Column:
    area_a = F.greatest(F.lit(0.0), (a.x1 - a.x0) * (a.y1 - a.y0))
    area_b = F.greatest(F.lit(0.0), (b.x1 - b.x0) * (b.y1 - b.y0))
    union = area_a + area_b - _intersection(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(_intersection(a, b) / F.nullif(union, F.lit(0.0)))


def contains_centre(b: Box, of: Box) -> Column:
    cx, cy = (of.x0 + of.x1) / 2.0, (of.y0 + of.y1) / 2.0
    return cx.between(b.x0, b.x1) & cy.between(b.y0, b.y1)


def title_block(w: Column, h: Column, expanded: bool = False) -> Box:
    """Where the title block is expected, by page size."""
    if expanded:
        large = (w > 1500) | (h > 1100)
        fx = F.when(large, 0.78).otherwise(0.52)
        fy = F.when(large, 0.86).otherwise(0.72)
    else:
        huge, large = (w >= 3000) | (h >= 2000), (w > 1500) | (h > 1100)
        fx = F.when(huge | large, 0.86).otherwise(0.62)
        fy = F.when(huge, 0.92).when(large, 0.90).otherwise(0.78)
    return Box(w * fx, h * fy, w, h)
