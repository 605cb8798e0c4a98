"""Boxes [x0, y0, x1, y1] as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PAGE_HEIGHT, PAGE_WIDTH
from .text import bound, rounded


def _side(box: Column, low: int) -> Column:
    return F.greatest(F.lit(0.0), box[low + 2] - box[low])


def area(box: Column) -> Column:
    return _side(box, 0) * _side(box, 1)


def missing(box: Column) -> Column:
    return box.isNull() | (F.size(box) == 0)


def intersection(a: Column, b: Column) -> Column:
    def overlap(i: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))

    return overlap(0) * overlap(1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where a box is missing or the union is empty."""

    def share(inter: Column) -> Column:
        return bound(area(a) + area(b) - inter, lambda union: F.when(union <= 0, F.lit(0.0)).otherwise(inter / F.nullif(union, F.lit(0.0))))

    return F.when(missing(a) | missing(b), F.lit(0.0)).otherwise(bound(intersection(a, b), share))


def covered(segment: Column, box: Column) -> Column:
    """Share of the segment inside the box; a degenerate segment counts as one of area 1e-6."""
    own = (segment[2] - segment[0]) * (segment[3] - segment[1])
    return intersection(segment, box) / F.greatest(F.lit(1e-6), own)


def text_in_box(layout: Column, box: Column, least: float = 0.5) -> Column:
    """The layout segments that lie in the box for at least that share."""
    return F.when(missing(box), F.slice(layout, 1, 0)).otherwise(F.filter(layout, lambda s: covered(s["bbox"], box) >= least))


def sorted_corners(box: Column, digits: int = 1) -> Column:
    """Corners in rising order, rounded; null unless there are four numbers."""
    made = F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))
    return F.when(F.size(box) == 4, F.transform(made, lambda x: rounded(x, digits)))


def scaled(box: Column, sx: Column, sy: Column) -> Column:
    return F.transform(box, lambda x, i: rounded(x * F.when(i % 2 == 0, sx).otherwise(sy), 1))


def rotated(box: Column, degrees: Column, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> Column:
    """The upright hull of the box turned about the page's centre, clipped to the page; degree 0 leaves it as it is."""
    cx, cy, t = width / 2, height / 2, F.radians(degrees)

    def products(turn: Column) -> Column:
        dx, dy = (box[0] - cx, box[2] - cx), (box[1] - cy, box[3] - cy)
        return F.array(*[d * turn[k] for ds in (dx, dy) for k in (0, 1) for d in ds])

    def hull(p: Column) -> Column:
        # of each corner's sum: the least is the sum of the least parts, as adding keeps the order
        dx_cos, dx_sin, dy_cos, dy_sin = ((p[i], p[i + 1]) for i in (0, 2, 4, 6))
        low = F.lit(cx) + F.least(*dx_cos) + F.least(*dy_sin), F.lit(cy) - F.greatest(*dx_sin) + F.least(*dy_cos)
        high = F.lit(cx) + F.greatest(*dx_cos) + F.greatest(*dy_sin), F.lit(cy) - F.least(*dx_sin) + F.greatest(*dy_cos)
        return F.array(F.greatest(F.lit(0.0), low[0]), F.greatest(F.lit(0.0), low[1]), F.least(F.lit(float(width)), high[0]), F.least(F.lit(float(height)), high[1]))

    turned = bound(F.array(F.cos(t), F.sin(t)), lambda turn: bound(products(turn), hull))
    return F.when(F.coalesce(degrees, F.lit(0.0)) == 0, box).otherwise(turned)
