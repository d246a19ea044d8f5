"""Outlines against known shapes and a plain walk round every region."""

from pathlib import Path

import numpy as np
import pytest
from test_rasters import _frame

from trackloom import rasters
from trackloom.operators.components import Scratch
from trackloom.rasters import outlines


def _shape(*lines):
    return np.array([[c == "#" for c in line] for line in lines], np.uint8)[..., None]


SHAPES = {
    1: _shape("....", ".##.", ".##.", "...."),
    2: _shape("#"),
    3: _shape("#####", "#...#", "#...#", "#####"),
    4: _shape("#..", ".#.", "..#"),
    5: _shape("..#..", ".###.", "#####", ".###.", "..#.."),
    6: _shape("....", "...."),
    7: (np.random.default_rng(3).random((23, 31, 1)) < 0.55).astype(np.uint8),
    8: np.ones((13, 9, 1), np.uint8),
    9: _shape("##.##", "#####", "##.##"),
}


def _walks(a):
    """Every border as its pixels in order: the walk keeps its right hand on the inside."""
    h, w = a.shape[:2]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w and a[y, x, 0] > 0
    heads = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    todo = {(y, x, d) for y in range(h) for x in range(w) for d in range(4) if inside(y, x) and not inside(y + heads[d - 1][0], x + heads[d - 1][1])}
    out = []
    while todo:
        start = at = min(todo)
        pixels, area = [], 0
        while at in todo:
            todo.remove(at)
            y, x, d = at
            area += {1: x + 1, 3: -x}.get(d, 0)
            (hy, hx), (ly, lx) = heads[d], heads[d - 1]
            if inside(y + hy + ly, x + hx + lx):
                at = (y + hy + ly, x + hx + lx, (d - 1) % 4)
            elif inside(y + hy, x + hx):
                at = (y + hy, x + hx, d)
            else:
                at = (y, x, (d + 1) % 4)
            if at[:2] != (y, x):
                pixels.append((x, y))
        assert at == start
        out.append((area < 0, pixels or [(start[1], start[0])]))
    return out


def _turned(pixels):
    """The same circle beginning at its smallest form, whatever its start."""
    return min(tuple(pixels[k:] + pixels[:k]) for k in range(len(pixels)))


def _corners(pixels):
    n = len(pixels)
    step = lambda k: (pixels[(k + 1) % n][0] - pixels[k % n][0], pixels[(k + 1) % n][1] - pixels[k % n][1])
    return [p for k, p in enumerate(pixels) if n == 1 or step(k - 1) != step(k)]


def _read(df):
    out = {}
    for r in df.orderBy("image", "outline", "place").collect():
        out.setdefault((r.image, r.outline), (r.hole, []))[1].append((r.x, r.y))
        assert r.place == len(out[r.image, r.outline][1]) - 1
    return {k: sorted((hole, _turned(pixels)) for (i, _), (hole, pixels) in out.items() if i == k) for k in SHAPES}


@pytest.mark.parametrize("size", [4, 64])
def test_outlines(spark, size):
    tiles = rasters.tiles(_frame(spark, SHAPES), size)
    with Scratch(spark) as scratch:
        every = _read(outlines.outlines(scratch, tiles, corners_only=False, size=size))
        corners = _read(outlines.outlines(scratch, tiles, size=size))
        outer = _read(outlines.outlines(scratch, tiles, holes=False, size=size))
    for k, a in SHAPES.items():
        walks = _walks(a)
        assert every[k] == sorted((hole, _turned(p)) for hole, p in walks)
        assert corners[k] == sorted((hole, _turned(_corners(p))) for hole, p in walks)
        assert outer[k] == [x for x in corners[k] if not x[0]]
    assert corners[1] == [(False, ((1, 1), (2, 1), (2, 2), (1, 2)))] and corners[2] == [(False, ((0, 0),))] and corners[6] == []
    assert [hole for hole, _ in corners[3]] == [False, True] and corners[3][0][1] == ((0, 0), (4, 0), (4, 3), (0, 3))
    assert corners[4] == [(False, ((0, 0), (2, 2)))]
    assert corners[5] == [(False, ((0, 2), (2, 0), (4, 2), (2, 4)))]


def test_rounds_leave_one_table(spark, monkeypatch):
    """Of the rounds' tables only the last one stays while the job goes on."""
    from pyspark.sql import functions as F

    from trackloom.operators import components

    tables = lambda scratch: len(list(Path(scratch.folder.removeprefix("file:")).iterdir()))
    with components.Scratch(spark) as scratch:
        circle = spark.range(40).select(F.lit(0).cast("long").alias("image"), F.col("id").alias("step"), ((F.col("id") + 1) % 40).alias("next"))
        got = outlines.ranked_circles(scratch, circle)
        assert sorted((r.circle, r.rank) for r in got.collect()) == [(0, k) for k in range(40)]
        assert tables(scratch) == 1
    with components.Scratch(spark) as scratch:
        line = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r.root for r in components.components(scratch, line).collect()} == {0}
        assert tables(scratch) == 2


@pytest.mark.parametrize(("size", "most"), [(64, 0), (8, 120)])
def test_rounds_hold_what_crosses_tiles(spark, monkeypatch, size, most):
    """Borders within a tile take part in no round, the others by one row for each time they enter one."""
    made, plainly = [], outlines.ranked_circles

    def counted(scratch, steps):
        made.append(steps.count())
        return plainly(scratch, steps)

    monkeypatch.setattr(outlines, "ranked_circles", counted)
    with Scratch(spark) as scratch:
        got = _read(outlines.outlines(scratch, rasters.tiles(_frame(spark, {7: SHAPES[7], 8: SHAPES[8]}), size), corners_only=False, size=size))
    assert [got[k] for k in (7, 8)] == [sorted((hole, _turned(p)) for hole, p in _walks(SHAPES[k])) for k in (7, 8)]
    assert made[0] <= most
