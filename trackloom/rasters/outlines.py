"""Outlines of masks by following the cracks between pixels inside and outside.

Every side of a pixel inside that faces one outside is a step, walked with the
inside to its right. Which step comes before and after depends on the pixels
next to it alone, so tiles with a border of one find all steps and their
order. A tile walks its steps itself: circles that stay within it are done
there, and of the others it leaves pieces, from where a border enters the tile
to where it goes out. Pieces form circles, whose order comes from doubling:
after k rounds a piece knows the smallest step among the 2^k pieces that
follow and how far off it is. No outline that leaves its tile is ever in one
place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch
from . import SIZE, Tile, stencil
from .regions import _inside

#: Per side of a pixel (top, right, bottom, left): where its step leads and what lies to its left, as (line, column).
_AHEAD, _LEFT = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 0), (0, 1), (1, 0), (0, -1))
#: Pieces, and for each tile one row without ``step`` that holds the pixels of its own circles. A piece: its first step, the next one's first step, its smallest step, and the pixels before that and in all.
PIECES = "image long, step long, next long, least long, off long, length long, area long, outlines array<long>, holes array<boolean>, places array<int>, ys array<int>, xs array<int>"


def _steps(p: np.ndarray, t: Tile) -> tuple[np.ndarray, ...]:
    """A tile's steps in order of their number: number, the one that follows, pixel (y, x), where it leads (dy, dx), area, and for those that come from another tile where that came from (fy, fx)."""
    held = (p[..., 0] > 0) & _inside(t, 1)
    at = lambda dy, dx: held[1 + dy : 1 + dy + t.h, 1 + dx : 1 + dx + t.w]
    out = []
    for side in range(4):
        (ay, ax), (ly, lx) = _AHEAD[side], _LEFT[side]
        y, x = np.nonzero(at(0, 0) & ~at(ly, lx))
        corner, ahead = at(ay + ly, ax + lx)[y, x], at(ay, ax)[y, x]
        dy, dx = np.where(corner, ay + ly, np.where(ahead, ay, 0)), np.where(corner, ax + lx, np.where(ahead, ax, 0))
        turn = np.where(corner, -1, np.where(ahead, 0, 1))
        # The step before turns left out of the pixel behind and to the left, or goes on from the one behind.
        aslant = at(ly - ay, lx - ax)[y, x]
        fy, fx = np.where(aslant, ay - ly, ay), np.where(aslant, ax - lx, ax)
        gy, gx = y + t.y0, x + t.x0
        number = lambda y, x, side: (y * t.width + x) * 4 + side
        area = gx + 1 if side == 1 else -gx if side == 3 else np.zeros_like(gx)
        out.append((number(gy, gx, side), number(gy + dy, gx + dx, (side + turn) % 4), gy, gx, dy, dx, area, fy, fx))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


def _walked(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The head of each step's chain and how many steps it comes after it; ``following`` are places, -1 where a chain goes out. A circle's head is its smallest place."""
    n = len(following)
    before = np.full(n, -1)
    before[following[following >= 0]] = np.flatnonzero(following >= 0)
    # Circles are those steps from which no head is reached; they are cut before their smallest place.
    back = np.where(before >= 0, before, np.arange(n))
    least, span = np.arange(n), 1
    while span < n:
        least, back, span = np.minimum(least, least[back]), back[back], span * 2
    round_ = before[back] >= 0
    before[round_ & (least == np.arange(n))] = -1
    head, rank = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    while True:
        onward = head[head]
        if (onward == head).all():
            return head, rank
        head, rank = onward, rank + rank[head]


def _pieces(corners_only: bool, holes: bool):
    def kernel(p: np.ndarray, t: Tile):
        step, follows, y, x, dy, dx, area, fy, fx = _steps(p, t)
        n = len(step)
        if not n:
            return []
        place = np.minimum(np.searchsorted(step, follows), n - 1)
        following = np.where(step[place] == follows, place, -1)
        head, rank = _walked(following)
        order = np.lexsort((rank, head))
        starts = np.flatnonzero(rank[order] == 0)
        chain = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        ends = np.r_[starts[1:], n] - 1
        step, follows, y, x, dy, dx, area, fy, fx = (c[order] for c in (step, follows, y, x, dy, dx, area, fy, fx))
        closed = (following[order] >= 0)[ends]
        areas = np.add.reduceat(area, starts)
        moves = (dy != 0) | (dx != 0)
        # A pixel is passed once for every move away from it; one that stands alone has no move, and its first step stands for it.
        alone = ~np.logical_or.reduceat(moves, starts)
        kept = moves.copy()
        kept[starts[alone]] = True
        if corners_only:
            moved = np.flatnonzero(moves)
            of = chain[moved]
            first, last = np.r_[True, of[1:] != of[:-1]][: len(of)], np.r_[of[1:] != of[:-1], True][: len(of)]
            came = []
            for d, f in ((dy, fy), (dx, fx)):
                end = np.zeros(len(starts), np.int64)
                end[of[last]] = d[moved[last]]
                came.append(np.where(first, np.where(closed[of], end[of], f[starts[of]]), np.r_[0, d[moved][:-1]][: len(of)]))
            kept[moved] = (came[0] != dy[moved]) | (came[1] != dx[moved])
        length = np.add.reduceat(kept.astype(np.int64), starts)
        within = np.cumsum(kept) - kept
        within -= np.repeat(within[starts], np.diff(np.r_[starts, n]))
        out, narrow = [], lambda v: v.astype(np.int32)
        shown = kept & (closed & (holes | (areas >= 0)))[chain]
        if shown.any():
            own = chain[shown]
            out.append((t.image, None, None, None, None, None, None, step[starts[own]], areas[own] < 0, narrow(within[shown]), narrow(y[shown]), narrow(x[shown])))
        for k in np.flatnonzero(~closed).tolist():
            part = slice(starts[k], ends[k] + 1)
            low = starts[k] + int(np.argmin(step[part]))
            held = kept[part]
            out.append((t.image, int(step[starts[k]]), int(follows[ends[k]]), int(step[low]), int(within[low]), int(length[k]), int(areas[k]), None, None, None, narrow(y[part][held]), narrow(x[part][held])))
        return out

    return kernel


def ranked_circles(scratch: Scratch, steps: DataFrame) -> DataFrame:
    """``steps`` (image, step, next: circles) with circle, the smallest step of their circle, and rank, how many steps they come after it. Steps may be pieces of several: then ``least`` is a piece's smallest step, ``off`` what comes before that in it, and ``length`` all that it counts for."""
    one = {"least": F.col("step"), "off": F.lit(0).cast("long"), "length": F.lit(1).cast("long")}
    whole = steps.withColumns({c: v for c, v in one.items() if c not in steps.columns})
    state = scratch.cut(whole.select("image", "step", F.col("next").alias("jump"), "least", "off", F.col("length").alias("span")))
    held = state
    while True:
        far = state.select("image", F.col("step").alias("jump"), *[F.col(c).alias("_" + c) for c in ("jump", "least", "off", "span")])
        less = F.col("_least") < F.col("least")
        held = scratch.replace(state.join(far, ["image", "jump"]).select("image", "step", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"), F.when(less, F.col("span") + F.col("_off")).otherwise(F.col("off")).alias("off"), (F.col("span") + F.col("_span")).alias("span"), less.alias("_moved")), held)
        state = held.drop("_moved")
        if held.where("_moved").isEmpty():
            break
    named = state.select("image", "step", F.col("least").alias("circle"), F.col("off").alias("_off")).join(whole.select("image", "step", "length"), ["image", "step"])
    lengths = named.groupBy("image", "circle").agg(F.sum("length").alias("_n"))
    ranked = named.join(lengths, ["image", "circle"]).select("image", "step", "circle", F.pmod(F.col("_n") - F.col("_off"), F.col("_n")).alias("rank"))
    return steps.join(ranked, ["image", "step"])


def outlines(scratch: Scratch, masks: DataFrame, corners_only: bool = True, holes: bool = True, size: int = SIZE) -> DataFrame:
    """image, outline, hole, place (from 0), x, y: the border pixels of a mask's regions, in order.

    ``masks`` are tiles of one channel, not zero inside; pixels hang together
    in eight directions. Outer borders run clockwise; the border of a hole runs
    along the pixels round it, the other way. A pixel stands as often as the
    border passes it. ``corners_only``: pixels at which a run that is level,
    upright or diagonal goes on are left out. An outline's number is its
    first step's.
    """
    pieces = scratch.cut(stencil(masks, _pieces(corners_only, holes), PIECES, size=size))
    own = pieces.where("step is null").select("image", F.inline(F.arrays_zip("outlines", "holes", "places", "xs", "ys"))).toDF("image", "outline", "hole", "place", "x", "y")
    cut = pieces.where("step is not null")
    whole = scratch.cut(ranked_circles(scratch, cut.select("image", "step", "next", "least", "off", "length", "area")))
    kinds = whole.groupBy("image", "circle").agg((F.sum("area") < 0).alias("hole"), F.sum("length").alias("_n"))
    met = whole.select("image", "step", "circle", "rank").join(kinds if holes else kinds.where("not hole"), ["image", "circle"])
    met = cut.select("image", "step", "ys", "xs").join(met, ["image", "step"]).select("image", "circle", "hole", "rank", "_n", F.posexplode(F.arrays_zip("xs", "ys")).alias("_at", "_p"))
    return own.unionAll(met.select("image", F.col("circle").alias("outline"), "hole", F.pmod(F.col("rank") + F.col("_at"), F.col("_n")).cast("int").alias("place"), "_p.xs", "_p.ys"))
