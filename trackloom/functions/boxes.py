"""Boxes with inclusive corners, as structs (x0, y0, x1, y1). All run inside the JVM; a null box gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((x0, y0, x1, y1), SIDES, strict=True)])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"] + 1


def height(b: Column) -> Column:
    return b["y1"] - b["y0"] + 1


def area(b: Column) -> Column:
    return width(b) * height(b)


def clamped_area(b: Column) -> Column:
    """Area with each side at least zero."""
    return F.greatest(F.lit(0), width(b)) * F.greatest(F.lit(0), height(b))


def size_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger area; null where an area is missing or zero."""
    low, high = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return F.when((area(a) != 0) & (area(b) != 0) & (high > 0), low / high)


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share; null if one is missing."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) + 1
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) + 1
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; zero where a box is missing or the union is empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.coalesce(F.when(union > 0, both / union), F.lit(0.0))


def intersection_fraction(own: Column, other: Column) -> Column:
    """Shared area over the first box's own area; zero where they are apart."""
    both = F.when((F.least(own["x1"], other["x1"]) >= F.greatest(own["x0"], other["x0"])) & (F.least(own["y1"], other["y1"]) >= F.greatest(own["y0"], other["y0"])), overlap(own, other)).otherwise(0)
    return both / F.greatest(area(own), F.lit(1.0))


def _whole(b: Column, x0, y0, x1, y1) -> Column:
    """A box of whole numbers; null where ``b`` is."""
    return F.when(b.isNotNull(), box(*[c.cast("long") for c in (x0, y0, x1, y1)]))


def _within(value: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), value))


def normalised(b: Column, frame_width: int, frame_height: int) -> Column:
    """Grown to whole pixels and clamped to the frame; null where nothing is left."""
    held = _whole(b, _within(F.floor(b["x0"]), frame_width), _within(F.floor(b["y0"]), frame_height), _within(F.ceil(b["x1"]), frame_width), _within(F.ceil(b["y1"]), frame_height))
    return F.when((held["x1"] > held["x0"]) & (held["y1"] > held["y0"]), held)


def _cut(b: Column, x0, y0, x1, y1, frame_width: int, frame_height: int) -> tuple[Column, Column]:
    clipped = (x0 < 0) | (y0 < 0) | (x1 >= frame_width) | (y1 >= frame_height)
    return _whole(b, F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0), F.least(F.lit(frame_width - 1), x1), F.least(F.lit(frame_height - 1), y1)), clipped


def padded(b: Column, frame_width: int, frame_height: int, pad_x: float, pad_y: float) -> tuple[Column, Column]:
    """The box with a margin in parts of its sides, cut at the frame, and whether it was cut."""
    w, h = width(b), height(b)
    return _cut(b, F.floor(b["x0"] - w * pad_x), F.floor(b["y0"] - h * pad_y), F.ceil(b["x1"] + w * pad_x), F.ceil(b["y1"] + h * pad_y), frame_width, frame_height)


def torso(b: Column, frame_width: int, frame_height: int, pad_x: float, y_start: float, y_end: float) -> tuple[Column, Column]:
    """A band of the box between two parts of its height, with side margins, and whether it was cut."""
    w, h = width(b), height(b)
    return _cut(b, F.floor(b["x0"] - w * pad_x), F.floor(b["y0"] + h * y_start), F.ceil(b["x1"] + w * pad_x), F.ceil(b["y0"] + h * y_end), frame_width, frame_height)


def padded_by_longer_side(b: Column, frame_width: int, frame_height: int, fraction: float, least: float) -> Column:
    """The box with one margin all round: a part of its longer side, ``least`` pixels at least."""
    pad = F.greatest(F.lit(float(least)), F.greatest(width(b), height(b)) * fraction)
    return _cut(b, F.floor(b["x0"] - pad), F.floor(b["y0"] - pad), F.ceil(b["x1"] + pad), F.ceil(b["y1"] + pad), frame_width, frame_height)[0]


def border_margin(b: Column, frame_width: int, frame_height: int) -> Column:
    """Least distance to a border of the frame."""
    return F.when(b.isNotNull(), F.least(b["x0"], b["y0"], frame_width - 1 - b["x1"], frame_height - 1 - b["y1"])).cast("long")


def clamped(b: Column, w: Column, h: Column) -> Column:
    """Whole pixels within an image of w x h; the far corner is never before the near one."""
    x0, y0 = F.greatest(F.lit(0), F.least(w - 1, F.floor(b["x0"]))), F.greatest(F.lit(0), F.least(h - 1, F.floor(b["y0"])))
    return _whole(b, x0, y0, F.greatest(x0, F.least(w - 1, F.ceil(b["x1"]))), F.greatest(y0, F.least(h - 1, F.ceil(b["y1"]))))


def fractional(w: Column, h: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A box given in parts of an image."""
    return clamped(box(w * x0, h * y0, w * x1 - 1, h * y1 - 1), w, h)


def padded_audit(b: Column, w: Column, h: Column) -> Column:
    """Room round a guessed number box; a missing one becomes a fixed part of the image. The margins and parts."""
    base = clamped(b, w, h)
    bw, bh = width(base), height(base)
    grown = clamped(box(base["x0"] - bw * 0.16, base["y0"] - bh * 0.14, base["x1"] + bw * 0.16, base["y1"] + bh * 0.18), w, h)
    return F.coalesce(F.when(b.isNotNull(), grown), fractional(w, h, 0.12, 0.06, 0.88, 0.72))


def default_number_region(w: Column, h: Column, torso_crop: Column) -> Column:
    """Where a number is looked for without any guess, by kind of crop. The parts."""
    def at(l, t, r, b):
        return box(F.floor(w * l), F.floor(h * t), F.greatest(F.lit(0), F.floor(w * r) - 1), F.greatest(F.lit(0), F.floor(h * b) - 1))

    return F.when(torso_crop, at(0.05, 0.03, 0.95, 0.97)).otherwise(at(0.10, 0.06, 0.90, 0.68))


def number_region(w: Column, h: Column, torso_crop: Column) -> Column:
    """The part of a crop that is measured for a number, one pixel wide and high at least. The parts."""
    def at(l, t, r, b):
        x0, y0 = F.floor(w * l), F.floor(h * t)
        return box(x0, y0, F.greatest(x0 + 1, F.least(w, F.floor(w * r))) - 1, F.greatest(y0 + 1, F.least(h, F.floor(h * b))) - 1)

    return F.when(torso_crop, at(0.08, 0.05, 0.92, 0.95)).otherwise(at(0.12, 0.08, 0.88, 0.66))


def text(b: Column) -> Column:
    """The corners joined by commas; null for no box."""
    return F.when(b.isNotNull(), F.concat_ws(",", *[b[s].cast("string") for s in SIDES]))


def as_list(b: Column) -> Column:
    """The corners as an array of doubles; null unless all four are there."""
    sides = [b[s].cast("double") for s in SIDES]
    known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
    return F.when(known, F.array(*sides))


def crop_rank(a: Column, sharpness: Column, border: Column) -> Column:
    """Area, sharpness up to a bound and distance to the border. The weights."""
    return a + F.least(sharpness, F.lit(5000.0)) * 10 + F.greatest(border, F.lit(0)) * 5


def best_crop_score(a: Column, border: Column, has_3d: Column, sharpness: Column) -> Column:
    """The weights."""
    return a + F.greatest(border, F.lit(0)) * 35 + F.when(has_3d, 2200).otherwise(0) + F.least(sharpness, F.lit(12000.0)) * 0.08
