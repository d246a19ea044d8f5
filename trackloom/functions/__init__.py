"""Scalar expressions: geometry, digits, rules. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import boxes


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in their order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes with inclusive corners, columns <prefix>x0..y1."""
    own = [boxes.box(*[F.col(p + k) for k in boxes.SIDES]) for p in (a, b)]
    return boxes.iou(*own)


def distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one is missing or both lengths multiply to next to nothing."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 1e-9, dot(a, b) / n)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges."""
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 == y1:
            continue
        over = (F.lit(y0) > y) != (F.lit(y1) > y)
        crossed = crossed + F.when(over & (x < F.lit((x1 - x0) / (y1 - y0)) * (y - y0) + x0), 1).otherwise(0)
    return crossed % 2 == 1


def projected(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """A point under a 3x3 homography; null where the scale vanishes."""
    line = lambda r: x * r[0] + y * r[1] + r[2]
    w = line(m[2])
    return F.when(w != 0, line(m[0]) / w), F.when(w != 0, line(m[1]) / w)


def feet_to_field(x: Column, y: Column, box=(0.0, 0.0, 1600.0, 700.0), length: float = 200.0, width: float = 85.0, origin: str = "top_left") -> tuple[Column, Column]:
    """Feet to template pixels; origins top_left, bottom_left or center."""
    if origin == "center":
        x, y = x + length / 2, y + width / 2
    elif origin == "bottom_left":
        y = F.lit(width) - y
    return x / length * (box[2] - box[0]) + box[0], y / width * (box[3] - box[1]) + box[1]


def digits(text: Column) -> Column:
    """Only the digits of a text, leading zeros kept; null when none."""
    kept = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(kept) > 0, kept)


def crop_quality(scale: Column, sharp: Column, blur: Column, resolution: Column, occlusion: Column, border: Column) -> Column:
    return scale * 0.25 + sharp * 0.24 + blur * 0.18 + resolution * 0.18 + occlusion * 0.10 + border * 0.05
