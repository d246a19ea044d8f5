"""Sampling, top-k and rule filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import reasons
from .components import Scratch


def strided(rows: DataFrame, group: list[str], order: list[str], stride: int, limit: int | None = None) -> DataFrame:
    """Every stride-th row of a group in order, the first ``limit`` of them."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    out = rows.withColumn("position", at).where(F.col("position") % stride == 0)
    return out if limit is None else out.where(F.col("position") < stride * limit)


def evenly_sampled(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of a group at evenly spaced positions, both ends included; positions round half to even. Null groups have no rows."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    held = rows.join(counts, group).withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.rint(k * (F.col("n") - 1) / F.lit(max(most - 1, 1))).cast("long"))
    return held.where((F.col("n") <= most) | F.array_contains(wanted, F.col("position").cast("long"))).drop("n")


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """``rows`` and their number from 0 in one order over all of them, without all of them in one task.

    Rows are dealt to ranges of the order and written in it; a range's count
    gives the next one its start. Only the counts, one a range, meet.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.cut(sorted_.withColumns({"_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def evenly_picked(scratch: Scratch, rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` of all rows, at evenly spaced places of one order, both ends included; places round half to even. Columns stay."""
    held = numbered(scratch, rows, order, "_at")
    n = held.count()
    if n <= most:
        return held.drop("_at")
    step = (n - 1) / max(most - 1, 1)
    guess = F.floor(F.col("_at") / step)
    at = F.lit(False)
    for k in (-1, 0, 1):  # the place whose rounding is this number, if there is one
        at |= (guess + k).between(0, most - 1) & (F.rint((guess + k) * F.lit(step)).cast("long") == F.col("_at"))
    return held.where(at).drop("_at")


def top_n(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def top_n_distinct(rows: DataFrame, group: list[str], distinct: str, order: list[Column], n: int) -> DataFrame:
    """The n best rows of a group with at most one row per value of ``distinct``."""
    return top_n(top_n(rows, [*group, distinct], order, 1, "_own").drop("_own"), group, order, n)


def best_sources(rows: DataFrame, n: int) -> DataFrame:
    """All variants of the n best sources of each track, one source a frame, with the source's rank.

    ``rows``: track_id, frame, source, readiness, torso. A source is ranked by
    its best readiness, then by whether any variant is a torso, then by name.
    """
    keys = ["track_id", "frame", "source"]
    own = rows.groupBy(*keys).agg(F.max("readiness").alias("_best"), F.max("torso").alias("_torso"))
    order = [F.desc("_best"), F.desc("_torso")]
    best = top_n(top_n(own, ["track_id", "frame"], [*order, F.col("source")], 1, "_own").drop("_own"), ["track_id"], [*order, F.col("frame"), F.col("source")], n)
    return rows.join(best.drop("_best", "_torso"), keys)


def selected_crops(crops: DataFrame, tracks: int, n: int) -> DataFrame:
    """The first ``tracks`` track ids and the n best distinct paths of each: track_id, path, crop_rank among all rows of the track.

    ``crops``: track_id, path, score, dup (order of repeats). Blank paths drop out.
    """
    first = crops.select("track_id").distinct().orderBy("track_id").limit(tracks)
    kept = crops.where(F.length("path") > 0).join(F.broadcast(first), "track_id", "left_semi")  # as many ids as asked for
    ranked = kept.withColumn("crop_rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("score"), "path", "dup")))
    paths = ranked.groupBy("track_id", "path").agg(F.min("crop_rank").alias("crop_rank"))
    return top_n(paths, ["track_id"], [F.col("crop_rank")], n)


def stride(fps: Column, sample_fps: Column) -> Column:
    """Every how many frames one is kept; halves go to the even number, one at least."""
    return F.greatest(F.lit(1), F.rint(fps / sample_fps).cast("long"))


def duration(frames: Column, fps: Column) -> Column:
    """Seconds of a video; null without a frame rate."""
    return F.when(fps > 0, frames / fps)


def clip_bounds(start: Column, length: Column, fps: Column, frames: Column) -> tuple[Column, Column]:
    """First frame of a slice and the one after its last, within the video."""
    first = F.floor(F.greatest(F.lit(0.0), start) * fps)
    return first.cast("long"), F.least(frames, first + F.ceil(F.greatest(F.lit(0.0), length) * fps)).cast("long")


def interval_frames(seconds: Column, interval: Column, fps: Column, last: Column, most: int) -> Column:
    """Frames at even intervals (a tenth of a second at least) up to the end, ``most`` of them, as an array; halves go to the even frame."""
    step = F.greatest(F.lit(0.1), interval)
    count = F.least(F.lit(most), F.floor(seconds / step) + 1)
    at = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.least(F.greatest(F.rint(k * step * fps), F.lit(0.0)), last.cast("double")).cast("long"))
    return F.when(count > 0, at).otherwise(F.array().cast("array<bigint>"))


def active_tracks(observations: DataFrame, least: int = 3, overlap: float = 0.25, limit: float = 0.5) -> DataFrame:
    """Per track: n, mean overlap (null counts as zero), reasons against it and whether it is kept.

    ``observations`` needs track_id, overlap, referee, bench (scores 0 to 1).
    A row without an overlap (a track without observations) doesn't count.
    """
    t = observations.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("overlap", F.lit(0.0))).alias("mean_overlap"), F.max("referee").alias("referee"), F.max("bench").alias("bench"))
    why = reasons((F.col("n") < least, "track_too_short"), (F.col("mean_overlap") < overlap, "insufficient_playing_surface_overlap"), (F.col("referee") >= limit, "referee_rejection"), (F.col("bench") >= limit, "bench_crowd_suppression"))
    return t.withColumn("reasons", why).withColumn("kept", F.size("reasons") == 0)


def best_paths(rows: DataFrame, group: list[str], path: str, score: str, position: str, n: int) -> DataFrame:
    """Per group the first n distinct non-empty paths by falling score (null: 0), ties by ``position``, as an ordered list."""
    order = [F.desc(F.coalesce(score, F.lit(0.0))), F.col(position)]
    best = top_n_distinct(rows.where(F.length(path) > 0), group, path, order, n)
    found = best.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", path))), lambda s: s[path]).alias("paths"))
    return rows.select(*group).distinct().join(found, group, "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
