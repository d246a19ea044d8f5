"""Masks on grids of points: nearest-index resampling, fused records, previews of point clouds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch
from ..operators.select import evenly_picked
from . import SIZE, Tile, tile_rows


def resampled(masks: DataFrame, width: int, height: int, size: int = SIZE) -> DataFrame:
    """(image, gx, gy): the cells of a grid of width x height that a mask covers.

    ``masks`` are tiles of one channel, not zero inside. A cell takes the
    mask's pixel at its own centre: column floor((gx + 1/2) W / width), and so
    for lines. A tile gives the cells whose pixel it holds, and only those
    that are inside, so no pixel becomes a row.
    """

    def kernel(p: np.ndarray, t: Tile):
        at = lambda n, total: (2 * np.arange(n) + 1) * total // (2 * n)
        x, y = at(width, t.width), at(height, t.height)
        xs, ys = np.flatnonzero((x >= t.x0) & (x < t.x0 + t.w)), np.flatnonzero((y >= t.y0) & (y < t.y0 + t.h))
        inside = p[..., 0][y[ys] - t.y0][:, x[xs] - t.x0] > 0
        return [(t.image, int(xs[i]), int(ys[j])) for j, i in zip(*np.nonzero(inside), strict=True)]

    return tile_rows(masks, kernel, "image long, gx int, gy int", size)


def usable(threshold: float, above: bool = False) -> Column:
    """Whether a point (x, y, z, confidence) is finite and sure enough: at least the threshold, or beyond it."""
    finite = F.lit(True)
    for c in ("x", "y", "z", "confidence"):
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return finite & ((F.col("confidence") > threshold) if above else (F.col("confidence") >= threshold))


def fused_masks(kept: DataFrame, masks: DataFrame, points: DataFrame, width: int, height: int, threshold: float, size: int = SIZE) -> DataFrame:
    """``kept`` (image, frame_index, mask_id) with what their masks hold of the points of their frame: point_count, centroid, low, high, spread (arrays of three), mean, least and largest confidence; and skip_reason.

    ``points``: frame_index, gx, gy, x, y, z, confidence. A mask whose frame
    has no points at all is skipped with ``no_matching_vggt_frame`` and counts
    nothing (null); one that holds no usable point counts zero. Null
    frame_index counts as a frame without points.
    """
    cells = resampled(masks, width, height, size).join(kept.select("image", "frame_index", "mask_id").distinct(), "image")
    held = cells.join(points.where(usable(threshold)), ["frame_index", "gx", "gy"])
    axes = ("x", "y", "z")
    stats = held.groupBy("image", "frame_index", "mask_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.array(*[f(F.col(c).cast("double")) for c in axes]).alias(n) for n, f in (("centroid", F.avg), ("low", F.min), ("high", F.max))],
        F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"))
    stats = stats.withColumn("spread", F.zip_with("high", "low", lambda a, b: a - b))
    frames = points.select(F.col("frame_index").alias("_frame")).distinct()
    met = kept.join(stats, ["image", "frame_index", "mask_id"], "left").join(frames, F.col("frame_index") == F.col("_frame"), "left")
    there = F.col("_frame").isNotNull()
    names = ("centroid", "low", "high", "spread", "confidence_mean", "confidence_min", "confidence_max")
    return met.select(*kept.columns, F.when(there, F.coalesce("_n", F.lit(0))).alias("point_count"), *names, F.when(~there, F.lit("no_matching_vggt_frame")).alias("skip_reason"))


def cloud_preview(scratch: Scratch, points: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points of the preview, one row on the cloud, one row a frame) of a cloud.

    A point counts where it is finite and surer than the threshold. The
    preview has ``most`` of them at most, evenly over the order of frame,
    line and column. The row on the cloud: total_valid_points,
    saved_preview_points, low, high; a frame's: frame_index, valid, zero for
    frames without any.
    """
    valid = points.where(usable(threshold, above=True))
    shown = scratch.cut(evenly_picked(scratch, valid, ["frame_index", "gy", "gx"], most))
    axes = ("x", "y", "z")
    whole = valid.agg(F.count(F.lit(1)).alias("total_valid_points"), *[F.when(F.count(F.lit(1)) > 0, F.array(*[f(c) for c in axes])).alias(n) for n, f in (("low", F.min), ("high", F.max))])
    whole = whole.withColumn("saved_preview_points", F.least(F.col("total_valid_points"), F.lit(most)))
    frames = points.groupBy("frame_index").agg(F.count_if(F.coalesce(usable(threshold, above=True), F.lit(False))).alias("valid"))
    return shown, whole, frames
