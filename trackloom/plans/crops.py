"""Queries over crops of frames, colours of points, file paths and measurements, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import points as pt
from ..operators import crops
from ..sources import boxes, observations, table
from .catalogue import BOX, OBS, query


@query(BOX + ", o AS (SELECT frame, part, box, CAST(x0 AS DOUBLE) - 3.5 AS x0, CAST(y0 AS DOUBLE) - 2 AS y0, CAST(x1 AS DOUBLE) + 0.5 AS x1, CAST(y1 AS DOUBLE) AS y1 FROM box), f AS (SELECT DISTINCT frame, CAST(frame % 30 + 20 AS BIGINT) AS w, CAST(frame % 9 + 4 AS BIGINT) AS h FROM o WHERE frame % 5 > 0), r AS (SELECT o.frame, part, box, greatest(0, CAST(round_even(x0, 0) AS BIGINT)) AS a, greatest(0, CAST(round_even(y0, 0) AS BIGINT)) AS b, least(w, CAST(round_even(x1, 0) AS BIGINT)) AS c, least(h, CAST(round_even(y1, 0) AS BIGINT)) AS d FROM o JOIN f USING (frame)) SELECT frame, part, box, concat_ws(',', a, b, c, d) AS corners, 'track_' || part || '/frame_' || CASE WHEN frame < 1000000 THEN lpad(CAST(frame AS VARCHAR), 6, '0') ELSE CAST(frame AS VARCHAR) END || '.jpg' AS path FROM r WHERE c > a AND d > b")
def player_crops(spark, d):
    """Boxes with exclusive ends, rounded half to even, cut to frames that are there."""
    b = boxes(spark, d)
    o = b.select("frame", "part", "box", F.array(F.col("x0") - 3.5, F.col("y0") - 2, F.col("x1") + 0.5, F.col("y1")).alias("bbox"))
    frames = b.select("frame").distinct().where("frame % 5 > 0").select("frame", (F.col("frame") % 30 + 20).alias("width"), (F.col("frame") % 9 + 4).alias("height"))
    held = crops.player_crops(o.withColumn("track_id", F.concat(F.lit("track_"), F.col("part").cast("string"))), frames)
    return held.select("frame", "part", "box", F.concat_ws(",", F.transform("corners", lambda v: v.cast("string"))).alias("corners"), "path")


def _channel(at: float) -> str:
    return f"CAST(floor(least(255, greatest(0, 40 + greatest(0, least(1, 1.5 - abs(3.0 * hue - {at}))) * (120 + 95 * norm)))) AS BIGINT)"


@query(OBS + f", m AS (SELECT greatest(max(frame - 473354), 1) AS last, min(score) AS low, max(score) AS high FROM obs), h AS (SELECT event_id, (frame - 473354) / CAST(last AS DOUBLE) AS hue, CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END AS norm FROM obs, m) SELECT event_id, {_channel(0.0)} AS red, {_channel(1.5)} AS green, {_channel(3.0)} AS blue FROM h")
def point_colours(spark, d):
    """Hue by frame, brightness by confidence. In double precision."""
    o = observations(spark, d).select("event_id", (F.col("frame") - 473354).alias("frame"), "score")
    return crops.coloured(o, "frame", "score").select("event_id", "red", "green", "blue")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/six/' || p_size WHEN p_size % 3 = 1 THEN '/three/' || p_size WHEN p_size < 20 THEN '/nth/' || p_size END AS path FROM part")
def frame_paths(spark, d):
    """A frame's file under its long name, its short one, or by its place in the listing."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("frame"))
    sizes = p.select("frame").distinct()
    of = lambda holds, name: sizes.where(holds).select("frame", F.concat(F.lit(f"/{name}/"), F.col("frame").cast("string")).alias("path"))
    return crops.frame_paths(p, of("frame % 3 = 0", "six"), of("frame % 3 < 2", "three"), of("frame < 20", "nth")).select("p_partkey", "path")


@query("SELECT doc_id, round(greatest(0, least(1, 0.42 * c + 0.36 * greatest(0, least(1, e / 0.16)) + 0.22 * greatest(0, least(1, k / 2.0)))), 6) AS signal FROM (SELECT doc_id, (doc_id % 11) / 10.0 AS c, (doc_id % 7) / 30.0 AS e, doc_id % 5 AS k FROM documents)")
def number_signal(spark, d):
    """J08's score out of measured contrast, edges and components."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.round(pt.number_signal((k % 11) / 10.0, (k % 7) / 30.0, k % 5), 6).alias("signal"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id WHEN doc_id % 3 = 1 THEN '/else/b' END AS artifact FROM documents")
def artifact_paths(spark, d):
    """A named artifact of a summary as a portable path, null where it isn't named."""
    k = F.col("doc_id")
    named = F.when(k % 3 == 0, F.create_map(F.lit("map"), F.concat(F.lit("/root/a/"), k.cast("string")))).when(k % 3 == 1, F.create_map(F.lit("map"), F.lit("/else/b"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return table(spark, d, "documents").select("doc_id", crops.artifact_path(named, "map", "/root").alias("artifact"))
