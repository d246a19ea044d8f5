"""Queries over small record shapes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, select, spatial
from ..sources import boxes, observations, table
from .catalogue import OBS, query


@query(OBS + "SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN CAST(x AS FLOAT) END AS DOUBLE) AS x, CAST(CASE WHEN event_id % 3 > 0 THEN CAST(y AS FLOAT) END AS DOUBLE) AS y FROM obs")
def point_arrays(spark, d):
    """Points to arrays of floats and back."""
    known = F.col("event_id") % 3 > 0
    point = F.when(known, F.struct("x", "y"))
    back = records.array_point(records.point_array(point))
    return observations(spark, d).select("event_id", back["x"].alias("x"), back["y"].alias("y"))


@query(OBS + "SELECT event_id FROM obs WHERE event_id % 4 = 1")
def inside_points(spark, d):
    """A flag that is true; some are false, some missing."""
    k = F.col("event_id") % 4
    return records.inside_points(observations(spark, d).withColumn("flag", F.when(k < 3, k == 1)), "flag").select("event_id")


@query(
    """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n,
       CASE doc_id % 3 WHEN 0 THEN doc_id + 1.5 WHEN 1 THEN doc_id + 1.25 ELSE 0 END AS total
FROM documents
"""
)
def number_values(spark, d):
    """Numbers among the values of JSON arrays; true is one."""
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), i, F.lit(', "7", 1.5, null]'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[true, 0.25, {}, "), i, F.lit("]"))).otherwise('{"a": 1}')
    values = records.number_values(text)
    return table(spark, d, "documents").select("doc_id", F.size(values).cast("long").alias("n"), F.aggregate(values, F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(OBS + "SELECT 'label' AS key, label AS value, count(*) AS n FROM obs GROUP BY label UNION ALL SELECT 'track_id', CAST(track_id AS VARCHAR), count(*) FROM obs GROUP BY track_id")
def variant_totals(spark, d):
    """Rows by variant and by track, in one pass."""
    return records.totals(observations(spark, d), "label", "track_id")


@query(OBS + "SELECT frame AS frame_index, event_id / 30.0 AS timestamp_sec, event_id AS source_frame_index, '/f/' || event_id AS path, 1920 AS width, 1080 AS height FROM obs")
def frame_records(spark, d):
    """B02."""
    o = observations(spark, d).select(F.col("frame").alias("frame_index"), (F.col("event_id") / 30.0).alias("timestamp_sec"), F.col("event_id").alias("source_frame_index"), F.concat(F.lit("/f/"), F.col("event_id").cast("string")).alias("path"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return records.frame_records(o)


@query(
    OBS
    + """
, r AS (SELECT *, floor(score / 50) AS ready, label <> 'purchase' AS other FROM obs),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY ready DESC, other, event_id) = 1)
SELECT track_id, frame, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ready DESC, other, frame) AS INTEGER) AS rank FROM f QUALIFY rank <= 4
"""
)
def top_crops(spark, d):
    """A track's best crops, one a frame: by readiness, then torsos, then the earlier frame."""
    o = observations(spark, d).withColumns({"ready": F.floor(F.col("score") / 50), "other": F.col("label") != "purchase"})
    return select.top_n_distinct(o, ["track_id"], "frame", [F.desc("ready"), F.col("other"), F.col("frame"), F.col("event_id")], 4).select("track_id", "frame", "event_id", "rank")


@query(OBS + "SELECT track_id, label AS variant, arg_max(event_id, (floor(score / 50), -frame, -event_id)) AS event_id FROM obs GROUP BY track_id, label")
def contact_sheet(spark, d):
    """A track's best row of each variant: by readiness, then the earlier frame."""
    best = F.max_by("event_id", F.struct(F.floor(F.col("score") / 50).alias("ready"), (-F.col("frame")).alias("frame"), (-F.col("event_id")).alias("event")))
    return observations(spark, d).groupBy("track_id", F.col("label").alias("variant")).agg(best.alias("event_id"))


@query(
    OBS
    + """
SELECT CAST(round_even(x, 0) AS BIGINT) AS cell_x, CAST(round_even(y, 0) AS BIGINT) AS cell_y, count(*) * 2.5 AS n
FROM obs WHERE event_id % 7 > 0 GROUP BY 1, 2 HAVING cell_x BETWEEN 0 AND 119 AND cell_y BETWEEN 0 AND 79
"""
)
def weighted_density(spark, d):
    """Each point counts its weight; points without a place count nowhere."""
    o = observations(spark, d).withColumn("x", F.when(F.col("event_id") % 7 > 0, F.col("x")))
    return spatial.density(o, 120, 80, 2.5)


@query(
    """
WITH c AS (SELECT doc_id, '/crops/' || doc_id % 500 AS path, n_chars / 1000.0 AS quality FROM documents),
k AS (SELECT path, arg_max(doc_id, doc_id) AS doc_id, arg_max(quality, doc_id) AS quality FROM c GROUP BY path),
a AS (SELECT doc_id, '/crops/' || doc_id % 700 AS path FROM documents WHERE doc_id % 2 = 0)
SELECT a.doc_id AS audit, k.doc_id AS crop, k.path AS crop_path, round(CASE a.doc_id % 6 WHEN 0 THEN 0.5 WHEN 2 THEN 0.25 ELSE quality END, 6) AS ready, CASE WHEN a.doc_id % 4 = 0 THEN 'back' ELSE 'unknown' END AS view
FROM a JOIN k USING (path) WHERE k.doc_id % 5 > 0
"""
)
def audited_crops(spark, d):
    """audits beside their crops by plain paths, with what stands in for what is missing; only crops whose file is there."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    text = lambda n: (i % n).cast("string")
    clean = docs.select(F.concat(F.lit("./old/../crops//"), text(500)).alias("crop_path"), i.alias("crop"), (F.col("n_chars") / 1000.0).alias("crop_quality_score"), i.alias("ordinal"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    audits = docs.where(i % 2 == 0).select(
        F.concat(F.lit("/crops/./"), text(700)).alias("crop_path"), F.when(i % 6 == 0, 0.5).alias("ocr_readiness_score"), F.when(i % 6 == 2, 0.25).alias("auto_quality_score"), F.lit(None).cast("double").alias("quality_score"),
        F.when(i % 4 == 0, "back").alias("heuristic_likely_view"), F.lit("").alias("likely_view"), F.lit(True).alias("ocr_candidate"), i.alias("audit_status"), none("rejection_reason"), none("number_region_box"), none("number_region_guess"))
    there = records.last_crops(clean).where(F.col("crop") % 5 > 0).select(F.col("crop_path").alias("path"))
    held, _ = records.audited_crops(clean, audits, "/", there)
    return held.select(F.col("audit_status").alias("audit"), "crop", "crop_path", F.round("ocr_readiness_score", 6).alias("ready"), F.col("heuristic_likely_view").alias("view"))


@query(
    OBS
    + """
, m AS (SELECT DISTINCT track_id, frame // 24 AS frame FROM obs), t AS (SELECT DISTINCT track_id FROM obs), p AS (SELECT track_id AS a, track_id + 1 AS b FROM t)
SELECT a, b, count(y.frame) AS shared FROM p LEFT JOIN m x ON x.track_id = a LEFT JOIN m y ON y.track_id = b AND y.frame = x.frame GROUP BY a, b
"""
)
def shared_frames(spark, d):
    """How many days two users that follow each other have in common."""
    m = observations(spark, d).select(F.col("track_id").alias("track"), F.expr("frame div 24").alias("frame"))
    pairs = m.select(F.col("track").alias("a"), (F.col("track") + 1).alias("b")).distinct()
    return records.shared_frames(m, pairs)


@query(
    """
WITH p AS (SELECT count(*) AS n FROM nation), f AS (SELECT DISTINCT l_linenumber AS frame FROM lineitem)
SELECT 'frame_004' AS name, 4 AS frame_index, CASE WHEN (SELECT count(*) FROM f WHERE frame = 4) > 0 THEN '/f/4' ELSE 'none' END AS frame_path, (SELECT n FROM p) AS points
UNION ALL SELECT 'frame_006', 6, '/f/6', 0 WHERE (SELECT count(*) FROM f WHERE frame = 6) > 0
UNION ALL SELECT 'frame_004', 4, '/f/4', (SELECT n FROM p) WHERE false
"""
)
def seed_keyframes(spark, d):
    """The keyframes of a new configuration; nations stand for its points."""
    points = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array(F.col("n_nationkey").cast("double")).alias("video_xy"), F.array(F.col("n_regionkey").cast("double")).alias("field_xy"))
    frames = boxes(spark, d).select(F.col("box").cast("long").alias("frame_index"), F.concat(F.lit("/f/"), F.col("box").cast("string")).alias("path")).distinct()
    k = records.seed_keyframes(points, frames, 4, 6, "none")
    return k.select("name", F.col("frame_index").cast("int").alias("frame_index"), "frame_path", F.size("points").cast("long").alias("points"))
