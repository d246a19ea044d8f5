"""Joins that tracking needs beyond equality. None of them makes all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes as bx

#: Frames that one block of the nearest join holds.
BLOCK = 1024


def range_join(left: DataFrame, right: DataFrame, at: str, other: str, lowest: int, highest: int, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``lowest <= right.other - left.at <= highest`` and equal ``on``, by buckets as wide as the range.

    Every left row goes to the two or three buckets that its range touches, so
    the join is an equality join with a bounded fan-out.
    """
    width = max(1, highest - lowest + 1)
    bucket = lambda c: F.floor(c / width)
    l_side = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(at) + lowest), bucket(F.col(at) + highest))))
    r_side = right.withColumn("_b", bucket(F.col(other)))
    met = l_side.join(r_side, [*(on or []), "_b"])
    return met.where((F.col(other) - F.col(at)).between(lowest, highest)).drop("_b")


def near_join(left: DataFrame, right: DataFrame, on: list[str], point: list[str], other: list[str], reach: float) -> DataFrame:
    """Pairs with equal ``on`` whose points are at most ``reach`` apart, by cells of that side.

    Every left row goes to its own cell and all around it (nine in the plane),
    every right row to one, so work grows with the rows that are near. Rows
    without a point have no pairs.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    cells = [f"_c{k}" for k in range(len(point))]
    for c, name in zip(point, cells, strict=True):
        left = left.where(F.col(c).isNotNull()).withColumn(name, F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    for c, name in zip(other, cells, strict=True):
        right = right.where(F.col(c).isNotNull()).withColumn(name, cell(c))
    apart = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(point, other, strict=True)), F.lit(0.0))
    return left.join(right, [*on, *cells]).where(F.sqrt(apart) <= reach).drop(*cells)


def touching_join(left: DataFrame, right: DataFrame, on: list[str], box: str, other: str, side: float = 64.0) -> DataFrame:
    """Pairs with equal ``on`` whose boxes share an area, each once, by the cells of a grid that the boxes cover.

    A pair is taken only in the cell that holds the corner where its overlap
    begins. Boxes should be of the order of ``side``; a frame's size bounds
    how many cells one can cover.
    """
    cell = lambda v: F.floor(v / side)

    def spread(df: DataFrame, b: str) -> DataFrame:
        c = F.col(b)
        # Inclusive corners: a box reaches one pixel beyond its far side.
        df = df.where(c.isNotNull()).withColumn("_cx", F.explode(F.sequence(cell(c["x0"]), cell(c["x1"] + 1))))
        return df.withColumn("_cy", F.explode(F.sequence(cell(c["y0"]), cell(c["y1"] + 1))))

    a, b = F.col(box), F.col(other)
    first = (F.col("_cx") == cell(F.greatest(a["x0"], b["x0"]))) & (F.col("_cy") == cell(F.greatest(a["y0"], b["y0"])))
    return spread(left, box).join(spread(right, other), [*on, "_cx", "_cy"]).where(first & (bx.overlap(a, b) > 0)).drop("_cx", "_cy")


def largest_overlap(rows: DataFrame, key: str, frame: list[str], box: str, width: int, height: int) -> DataFrame:
    """(key, overlap): the largest share of a row's own box that another row of its frame covers.

    Boxes are cut to the frame first; 1 where nothing of the own box is left, 0
    where it is alone.
    """
    own = rows.select(key, *frame, bx.normalised(F.col(box), width, height).alias("_b"))
    other = own.select(*frame, F.col(key).alias("_key"), F.col("_b").alias("_o"))
    met = touching_join(own, other, frame, "_b", "_o").where(F.col(key) != F.col("_key"))
    most = met.groupBy(key).agg(F.max(bx.intersection_fraction(F.col("_b"), F.col("_o"))).alias("_most"))
    return own.join(most, key, "left").select(key, F.when(F.col("_b").isNull(), 1.0).otherwise(F.coalesce("_most", F.lit(0.0))).alias("overlap"))


def nearest_join(points: DataFrame, frames: DataFrame, frame: str, key: str, most: int) -> DataFrame:
    """Each point with its nearest keyframe, ties to the lower one; null beyond ``most``. All keyframes count.

    Frames and keyframes are put in order block by block; a frame takes the
    last keyframe up to it and the next from it on within its block, or else
    the nearest blocks' own. So no frame meets all keyframes, and no task
    holds more than a block, or one row per block.
    """
    ask = points.where(F.col(frame).isNotNull()).select(F.col(frame).cast("long").alias("_at")).distinct().withColumn("_key", F.lit(None).cast("long"))
    keys = frames.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_at"), F.col(key).cast("long").alias("_key")).distinct()
    both = ask.unionAll(keys).withColumn("_b", F.floor(F.col("_at") / BLOCK))
    blocks = both.groupBy("_b").agg(F.min("_key").alias("_min"), F.max("_key").alias("_max"))
    over = Window.orderBy("_b")
    blocks = blocks.select("_b", F.max("_max").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_min").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    within = Window.partitionBy("_b").orderBy("_at")
    near = both.withColumns({"_last": F.max("_key").over(within.rangeBetween(Window.unboundedPreceding, 0)), "_next": F.min("_key").over(within.rangeBetween(0, Window.unboundedFollowing))}).where("_key is null").join(blocks, "_b")
    last, later = F.coalesce("_last", "_before"), F.coalesce("_next", "_after")
    lower = later.isNull() | (last.isNotNull() & (F.col("_at") - last <= later - F.col("_at")))
    held = near.select("_at", F.when(lower, last).otherwise(later).alias("_near")).withColumn("frame_distance", F.abs(F.col("_at") - F.col("_near")))
    held = held.select("_at", F.when(F.col("frame_distance") <= most, F.col("_near")).alias("keyframe"), "frame_distance")
    return points.join(held, F.col(frame) == F.col("_at"), "left").drop("_at")


def fallback_join(rows: DataFrame, exact: DataFrame, loose: DataFrame, keys: list[str], loose_keys: list[str], value: str) -> DataFrame:
    """``value`` by all keys, else by the looser keys; both sides must be unique by their keys."""
    a = exact.select(*keys, F.col(value).alias("_a"))
    b = loose.select(*loose_keys, F.col(value).alias("_b"))
    return rows.join(a, keys, "left").join(b, loose_keys, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def last_by(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the last in order: what building an index by assignment leaves. Null keys drop out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), ordinal).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def mutual_nearest(pairs: DataFrame, left: str, right: str, cost: Column) -> DataFrame:
    """Pairs that are each other's cheapest, ties to the smaller ids."""
    best = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(cost, o))
    return pairs.withColumns({"_l": best(left, right), "_r": best(right, left)}).where("_l = 1 and _r = 1").drop("_l", "_r")


def attached(rows: DataFrame, details: DataFrame, keys: list[str], order: list[str], name: str, most: int) -> DataFrame:
    """``rows`` and ``name``: the first ``most`` matching details in order as an array of structs, empty where there are none."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rest = [c for c in details.columns if c not in keys]
    few = details.withColumn("_at", at).where(F.col("_at") <= most)
    held = few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.struct(*rest).alias("r")))), lambda s: s["r"]).alias(name))
    empty = F.array().cast(held.schema[name].dataType)
    return rows.join(held, keys, "left").withColumn(name, F.coalesce(name, empty))
