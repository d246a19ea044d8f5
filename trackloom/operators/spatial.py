"""Density grids and smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def density(points: DataFrame, width: int, height: int, weight: float | None = None) -> DataFrame:
    """Counts per cell, or their ``weight`` in all; coordinates round half to even and cells outside the field drop out, as do points without a place."""
    cells = points.select(F.rint("x").cast("long").alias("cell_x"), F.rint("y").cast("long").alias("cell_y"))
    return cells.where(F.col("cell_x").between(0, width - 1) & F.col("cell_y").between(0, height - 1)).groupBy("cell_x", "cell_y").agg((F.count(F.lit(1)) * (1 if weight is None else F.lit(weight))).alias("n"))


def normalised(grid: DataFrame) -> DataFrame:
    """Counts as 0 to 255 of the largest, cut to whole numbers; all zero where the largest is next to nothing."""
    most = grid.agg(F.max("n").alias("most"))  # one row
    level = F.when(F.col("most") > 1e-9, F.floor(F.least(F.lit(255.0), F.col("n") * 255.0 / F.col("most")))).otherwise(0)
    return grid.crossJoin(F.broadcast(most)).withColumn("level", level.cast("long")).drop("most")


def _along(grid: DataFrame, axis: str, other: str, cells: int, sigma: float, reach: int) -> DataFrame:
    """One pass of a Gaussian whose border cells stand for all beyond them; weight outside the field is not made."""
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total, last = sum(weights), cells - 1
    one = F.array(*[F.lit(w / total) for w in weights])
    upto = F.array(*[F.lit(sum(weights[: k + 1]) / total) for k in range(len(weights))])
    at, to = F.col(axis), F.col("to")
    sent = grid.select(axis, other, "n", F.explode(F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(last)))).alias("to"))
    pick = lambda table, k: F.element_at(table, (k + reach + 1).cast("int"))
    weight = F.when((at == 0) & (at == last), 1.0).when(at == 0, pick(upto, -to)).when(at == last, pick(upto, to - last)).otherwise(pick(one, at - to))
    return sent.groupBy(to.alias(axis), other).agg(F.sum(F.col("n") * weight).alias("n"))


def smoothed_field(grid: DataFrame, width: int, height: int, sigma: float, reach: int) -> DataFrame:
    """A Gaussian along x and y with replicated borders; the grid itself when sigma is not positive."""
    if sigma > 0:
        grid = _along(_along(grid, "cell_x", "cell_y", width, sigma, reach), "cell_y", "cell_x", height, sigma, reach)
    return grid.select("cell_x", "cell_y", F.col("n").cast("double").alias("smooth"))


def running_totals(counts: DataFrame, at: str, value: str, total: str, keys: list[str] | None = None) -> DataFrame:
    """``counts`` and the sum of ``value`` over all rows up to ``at``, without all rows in one task.

    Rows are grouped into blocks of ``at``; blocks are added up on their own,
    and every row takes the total of the blocks before its own. The table of
    blocks is a ``BLOCK``-th of the range of ``at`` and is joined, not
    broadcast by force. ``at`` is a whole number and unique per ``keys``.
    """
    keys = keys or []
    block = F.floor(F.col(at) / BLOCK)
    held = counts.withColumn("_block", block)
    sums = held.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    coarse = sums.withColumn("_coarse", F.floor(F.col("_block") / BLOCK))
    over = coarse.groupBy(*keys, "_coarse").agg(F.sum("_sum").alias("_all"))
    before_all = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    over = over.withColumn("_base", F.coalesce(F.sum("_all").over(before_all), F.lit(0))).drop("_all")
    before = Window.partitionBy(*keys, "_coarse").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = coarse.join(over, [*keys, "_coarse"]).withColumn("_start", F.col("_base") + F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*keys, "_block", "_start")
    within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return held.join(starts, [*keys, "_block"]).withColumn(total, F.col("_start") + F.sum(value).over(within)).drop("_block", "_start")


#: Values of the running column that one block holds.
BLOCK = 1024


def cumulative(points: DataFrame) -> DataFrame:
    """Points seen up to each frame, over all tracks, from per-frame counts."""
    counts = points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "frame", "n", "seen")


def cumulative_cells(points: DataFrame, width: int, height: int) -> DataFrame:
    """Per cell of the field and frame in which it is met: points there so far (frame, cell_x, cell_y, n, seen); points outside drop out."""
    at = points.select("frame", F.rint("x").cast("long").alias("cell_x"), F.rint("y").cast("long").alias("cell_y"))
    inside = at.where(F.col("cell_x").between(0, width - 1) & F.col("cell_y").between(0, height - 1))
    counts = inside.groupBy("cell_x", "cell_y", "frame").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("seen", F.sum("n").over(Window.partitionBy("cell_x", "cell_y").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))


def feet_summary(points: DataFrame, length: float, width: float) -> DataFrame:
    """One row over points (frame, track_id, x_ft, y_ft): frames, tracks, points inside the closed bounds and outside, and their reach."""
    ok = F.coalesce(F.col("x_ft").between(0, length) & F.col("y_ft").between(0, width), F.lit(False))
    reach = [f(F.col(c + "_ft")).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    held = points.agg(F.countDistinct("frame").alias("frames"), F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("points"), F.count_if(ok).alias("inside"), F.count_if(~ok).alias("outside"), *reach)
    return held.withColumns({f"{c}_{n}": F.round(f"{c}_{n}", 4) for c in "xy" for n in ("min", "max")})


def mean_histograms(rows: DataFrame, keys: list[str], hist: str) -> DataFrame:
    """(keys, mean): the mean of a group's histograms scaled to length one; null where they cancel out. Null histograms don't count."""
    bins = rows.where(F.col(hist).isNotNull()).select(*keys, F.posexplode(hist).alias("_bin", "_v")).groupBy(*keys, "_bin").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    mean = bins.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_bin", "_v"))), lambda s: s["_v"]).alias("_m"))  # a row per bin
    size = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda s, v: s + v * v))
    return mean.select(*keys, F.when(size > 1e-9, F.transform("_m", lambda v: v / size)).alias("mean"))
