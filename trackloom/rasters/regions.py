"""Edges, connected regions and what a number region shows, tile by tile.

A region is labelled by its first pixel's number (line by line from the top).
Within a tile, labels come from union by minimum; across tiles, from links
between a tile's labels and the labels of the pixels just beyond its border,
which Spark joins and closes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch, components
from . import SIZE, TILES, Tile, _array, _batches, _place, _rows, stencil, tile_rows
from .colour import grey_14
from .measures import _total, _variance

#: Thresholds of an edge, and the tangent of 22.5 degrees with 15 bits behind the point.
LOW, HIGH, TANGENT = 60, 160, 13573
NONE, WEAK, STRONG = 0, 1, 2


def _inside(t: Tile, radius: int) -> np.ndarray:
    """Which pixels of a tile with its border are within the raster."""
    y, x = np.arange(t.y0 - radius, t.y0 + t.h + radius), np.arange(t.x0 - radius, t.x0 + t.w + radius)
    return ((y >= 0) & (y < t.height))[:, None] & ((x >= 0) & (x < t.width))[None, :]


def thin_edges(tiles: DataFrame, low: int = LOW, high: int = HIGH, size: int = SIZE) -> DataFrame:
    """Tiles of one channel: ridges of the grey's gradient, weak above ``low`` and strong above ``high``.

    The gradient is Sobel's with the outermost pixels repeated, its size the
    sum of both parts. A pixel stays where none of its two neighbours along
    the gradient (in four directions) is steeper; beyond the raster all is
    flat.
    """

    def kernel(p: np.ndarray, t: Tile):
        g = grey_14(p)
        dx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
        dy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
        steep = np.where(_inside(t, 1), np.abs(dx) + np.abs(dy), 0)
        at = lambda y, x: steep[1 + y : 1 + y + t.h, 1 + x : 1 + x + t.w]
        m, dx, dy = at(0, 0), dx[1:-1, 1:-1], dy[1:-1, 1:-1]
        flat = np.abs(dx) * TANGENT
        tall = np.abs(dy) << 15
        across = (m > at(0, -1)) & (m >= at(0, 1))
        down = (m > at(-1, 0)) & (m >= at(1, 0))
        fall = np.where((dx ^ dy) < 0, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))
        ridge = np.where(tall < flat, across, np.where(tall > flat + (np.abs(dx) << 16), down, fall)) & (m > low)
        out = np.where(ridge, np.where(m > high, STRONG, WEAK), NONE).astype(np.uint8)
        return [(t.image, t.width, t.height, 1, t.ty, t.tx, out.tobytes())]

    return stencil(tiles, kernel, TILES, radius=2, size=size)


EIGHT, FOUR = ((0, 1), (1, -1), (1, 0), (1, 1)), ((0, 1), (1, 0))


def local_labels(held: np.ndarray, steps: tuple) -> np.ndarray:
    """For each pixel the number of its region's first pixel within the array, -1 where ``held`` is false."""
    h, w = held.shape
    number = np.arange(h * w).reshape(h, w)
    ends = []
    for dy, dx in steps:
        a = np.s_[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = np.s_[dy:, max(0, dx) : w - max(0, -dx)]
        both = held[a] & held[b]
        ends.append((number[a][both], number[b][both]))
    i, j = (np.concatenate(e) for e in zip(*ends, strict=True))
    root = np.arange(h * w)
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], least)
        np.minimum.at(root, before[j], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return np.where(held, root.reshape(h, w), -1)


PARTS = "image long, ty int, tx int, label long, n long, strong long, border long, x0 long, y0 long, x1 long, y1 long, kind int, pixel long"
_PART, _OWN, _BEYOND = 0, 1, 2


def _labels(p: np.ndarray, t: Tile, background: bool) -> tuple[np.ndarray, np.ndarray]:
    """A tile with a border of one: which of its pixels are held, and the labels of its own ones."""
    held = (((p[..., 0] == 0) if background else (p[..., 0] > 0)) & _inside(t, 1))
    own = local_labels(held[1:-1, 1:-1], FOUR if background else EIGHT)
    y, x = np.divmod(np.maximum(own, 0), t.w)
    return held, np.where(own >= 0, (t.y0 + y) * t.width + t.x0 + x, -1)


def _beyond(t: Tile, pick: np.ndarray, values: np.ndarray, steps: tuple) -> set[tuple[int, int]]:
    """(value, number of the pixel) of a tile's pixels and the picked pixels just beyond its border next to them."""
    found = set()
    all_steps = [*steps, *[(-dy, -dx) for dy, dx in steps]]
    for dy, dx in all_steps:
        y, x = np.nonzero((values >= 0) & pick[1 + dy : 1 + dy + t.h, 1 + dx : 1 + dx + t.w])
        oy, ox = y + dy, x + dx
        out = (oy < 0) | (oy >= t.h) | (ox < 0) | (ox >= t.w)
        found.update(zip(values[y[out], x[out]].tolist(), ((t.y0 + oy[out]) * t.width + t.x0 + ox[out]).tolist(), strict=True))
    return found


def _parts(background: bool) -> Callable:
    steps = FOUR if background else EIGHT

    def kernel(p: np.ndarray, t: Tile):
        held, labels = _labels(p, t, background)
        y, x = np.nonzero(labels >= 0)
        if not len(y):
            return []
        own, inverse = np.unique(labels[y, x], return_inverse=True)
        at_rim = (y + t.y0 == 0) | (x + t.x0 == 0) | (y + t.y0 == t.height - 1) | (x + t.x0 == t.width - 1)
        add = lambda w: np.bincount(inverse, w, len(own)).astype(np.int64)
        n, strong, rim = add(None), add(p[1:-1, 1:-1, 0][y, x] == STRONG), add(at_rim)
        ends = []
        for v, pick in ((x + t.x0, np.minimum), (y + t.y0, np.minimum), (x + t.x0, np.maximum), (y + t.y0, np.maximum)):
            side = np.full(len(own), np.iinfo(np.int64).max if pick is np.minimum else -1)
            pick.at(side, inverse, v)
            ends.append(side)
        out = [(t.image, t.ty, t.tx, *map(int, r), _PART, None) for r in zip(own, n, strong, rim, *ends, strict=True)]
        blank = (0,) * 7
        inner = np.zeros((t.h, t.w), bool)
        inner[1:-1, 1:-1] = True
        y, x = np.nonzero((labels >= 0) & ~inner)
        out += [(t.image, t.ty, t.tx, int(v), *blank, _OWN, int(k)) for v, k in zip(labels[y, x], (y + t.y0) * t.width + x + t.x0, strict=True)]
        out += [(t.image, t.ty, t.tx, v, *blank, _BEYOND, k) for v, k in _beyond(t, held, labels, steps)]
        return out

    return kernel


class _Regions:
    """Regions of the pixels that are not zero, in eight directions, or of those that are, in four.

    ``roots``: image, label, root of the labels that hang together with one of
    another tile. ``parts``: a tile's regions. ``whole``: regions of the
    raster. ``rim``: the pixels on tiles' borders with their root.
    """

    def __init__(self, scratch: Scratch, tiles: DataFrame, background: bool, size: int):
        rows = scratch.cut(stencil(tiles, _parts(background), PARTS, size=size))
        seen = rows.where(F.col("kind") == _OWN).select("image", "pixel", F.col("label").alias("other"))
        met = rows.where(F.col("kind") == _BEYOND).select("image", "label", "pixel").join(seen, ["image", "pixel"])
        links = met.select(F.struct("image", "label").alias("a"), F.struct("image", F.col("other").alias("label")).alias("b"))
        self.roots = components(scratch, links).select("node.image", "node.label", F.col("root.label").alias("root"))
        self.parts = self.rooted(rows.where(F.col("kind") == _PART).drop("kind", "pixel"))
        self.rim = self.rooted(rows.where(F.col("kind") == _OWN).select("image", "label", "pixel"))
        self.whole = self.parts.groupBy("image", "root").agg(*[F.sum(c).alias(c) for c in ("n", "strong", "border")], *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])

    def rooted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.roots, ["image", "label"], "left").withColumn("root", F.coalesce("root", "label"))


def edge_map(scratch: Scratch, tiles: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles of one channel, 2 where there is an edge; edge regions: image, root, n, border, x0, y0, x1, y1; their parts: image, label, root). Weak ridges count where they hang together with a strong one."""
    ridges = scratch.cut(thin_edges(tiles, size=size))
    found = _Regions(scratch, ridges, False, size)
    whole = scratch.cut(found.whole.where("strong > 0").drop("strong"))
    parts = scratch.cut(found.parts.select("image", "ty", "tx", "label", "root").join(whole.select("image", "root"), ["image", "root"], "left_semi"))
    kept = parts.groupBy("image", "ty", "tx").agg(F.collect_list("label").alias("kept"))  # one tile's labels

    def paint(batches):
        def each():
            for image, width, height, channels, ty, tx, pixels, labels in _rows(batches):
                t = _place(image, width, height, ty, tx, size)
                own = np.zeros((t.h + 2, t.w + 2, 1), np.uint8)
                own[1:-1, 1:-1] = _array(pixels, t.h, t.w, channels)
                _, found = _labels(own, t, False)
                yield image, width, height, 1, ty, tx, np.where(np.isin(found, labels or []), STRONG, NONE).astype(np.uint8).tobytes()

        yield from _batches(each(), TILES)

    painted = ridges.join(kept, ["image", "ty", "tx"], "left").select(*ridges.columns, "kept").mapInArrow(paint, TILES)
    return scratch.cut(painted), whole, parts.drop("ty", "tx")


def outer_regions(scratch: Scratch, tiles: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(edge regions that no other one encloses, all edge regions): image, root, n, border, x0, y0, x1, y1.

    Pixels without an edge hang together in four directions. A region is
    outermost where it touches the raster's rim or pixels that hang together
    with the rim.
    """
    edges, whole, parts = edge_map(scratch, tiles, size)
    ground = _Regions(scratch, edges, True, size)
    outside = ground.whole.where("border > 0").select("image", F.col("root").alias("ground"))

    def touch(p: np.ndarray, t: Tile):
        """The edge labels of a tile with the ground labels next to them, or with the ground pixels next to them beyond the tile."""
        _, lines = _labels(p, t, False)
        free, own = _labels(p, t, True)
        found = set()
        for a, b in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[1:], np.s_[:-1])):
            for x, y in ((a, b), (b, a)):
                both = (lines[x] >= 0) & (own[y] >= 0)
                found.update(zip(lines[x][both].tolist(), own[y][both].tolist(), strict=True))
        return [*((t.image, a, b, None) for a, b in found), *((t.image, a, None, k) for a, k in _beyond(t, free, lines, FOUR))]

    met = scratch.cut(stencil(edges, touch, "image long, line long, label long, pixel long", size=size))
    near = ground.rooted(met.where("label is not null").select("image", "line", "label")).select("image", "line", F.col("root").alias("ground"))
    far = met.where("pixel is not null").select("image", "line", "pixel").join(ground.rim, ["image", "pixel"]).select("image", "line", F.col("root").alias("ground"))
    free = near.unionAll(far).join(outside, ["image", "ground"], "left_semi").select("image", F.col("line").alias("label")).distinct()
    roots = parts.join(free, ["image", "label"], "left_semi").select("image", "root").unionAll(whole.where("border > 0").select("image", "root")).distinct()
    return whole.join(roots, ["image", "root"], "left_semi"), whole


def number_region_metrics(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """image, contrast_score, edge_density, edge_score, digit_like_component_count, digit_like_components (x, y, width, height, in order of place) and number_visibility_signal of a number region.

    A component is an outermost edge region; it looks like a digit by the
    shares of its box. Fixed values: those shares and the weights. Rasters
    without pixels have no row. The result is a table in the shared folder.
    """
    schema = "image long, width int, height int, n long, grey long, grey2 long"

    def kernel(p: np.ndarray, t: Tile):
        g = grey_14(p)
        return [(t.image, t.width, t.height, g.size, int(g.sum()), int((g * g).sum()))]

    own = _total(tile_rows(tiles, kernel, schema, size), schema, "image", "width", "height")
    scratch = Scratch(tiles.sparkSession)
    with scratch:
        outer, whole = outer_regions(scratch, tiles, size)
        return scratch.keep(_scored(own, outer, whole))


def _scored(own: DataFrame, outer: DataFrame, whole: DataFrame) -> DataFrame:
    edges = whole.groupBy("image").agg(F.sum("n").alias("edges"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    wide, tall = w / F.col("width"), h / F.col("height")
    like = wide.between(0.03, 0.55) & tall.between(0.15, 0.88) & (w * h / (F.col("width").cast("long") * F.col("height"))).between(0.004, 0.30) & (w / h).between(0.10, 1.45) & ((F.col("x0") + w / 2.0) / F.col("width")).between(0.12, 0.88)
    box = F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), w.alias("width"), h.alias("height"))
    digits = outer.join(own.select("image", "width", "height"), "image").where(like).groupBy("image").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    held = own.join(edges, "image", "left").join(digits, "image", "left")
    held = held.withColumns({
        "contrast_score": clip(F.sqrt(_variance("grey", "grey2", "n")) / 64.0), "edge_density": F.coalesce("edges", F.lit(0)) / F.col("n"), 
        "digit_like_components": F.transform(F.coalesce("boxes", F.array().cast("array<struct<y: long, x: long, width: long, height: long>>")), lambda b: F.struct(b.x.alias("x"), b.y.alias("y"), b.width.alias("width"), b.height.alias("height")))})
    held = held.withColumn("digit_like_component_count", F.size("digit_like_components")).withColumn("edge_score", clip(F.col("edge_density") / 0.16))
    signal = F.col("contrast_score") * 0.42 + F.col("edge_score") * 0.36 + clip(F.col("digit_like_component_count") / 2.0) * 0.22
    return held.select("image", "contrast_score", "edge_density", "edge_score", "digit_like_component_count", "digit_like_components", clip(signal).alias("number_visibility_signal"))
