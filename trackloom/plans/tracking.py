"""Queries over association, trackers, merges and projections, each beside its SQL where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes as bx
from ..functions import projected
from ..operators import filters, joins, spatial, tracks
from ..operators.components import Scratch
from ..sources import observations, table_stream
from ..streaming.tracker import EVENTS, track_stream
from .catalogue import KEYFRAMES, MATRIX, OBS, query


#: Where a stream keeps its state, and the hour before the first event's.
ROCKS, FIRST_HOUR = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", 473_000


def detections(spark, d, events=None):
    """events as detections: the clip is the label, the frame the hour; some have no foot, box, third dimension or histogram."""
    x, y, i = F.col("x"), F.col("y"), F.col("event_id")
    o = observations(spark, d, events).select("event_id", "label", "track_id", "frame", "x", "y")
    known = lambda n, v: F.when(i % n != 0, v)
    return o.withColumns({
        "foot_x": known(7, x), "foot_y": known(7, y + 4), "box": known(11, bx.box(x - 4, y - 9, x + 4, y + 9)),
        "p3": known(5, F.array(x / 100, y / 100, F.lit(1.0))), "hist": known(3, F.array(x, y, F.lit(50.0)))})


_PAIRS = OBS + """, p AS (SELECT a.event_id AS a, b.event_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM obs a JOIN obs b ON b.frame = a.frame + 1 AND a.label = b.label),
q AS (SELECT a, b, sqrt((ax - bx) * (ax - bx) + (ay - byy) * (ay - byy)) AS c, a % 7 <> 0 AND b % 7 <> 0 AS feet, CASE WHEN a % 11 <> 0 AND b % 11 <> 0 THEN greatest(0, 9 - abs(ax - bx)) * greatest(0, 19 - abs(ay - byy)) ELSE 0 END AS shared,
CASE WHEN a % 5 <> 0 AND b % 5 <> 0 THEN sqrt(pow(CAST(CAST(ax / 100 AS FLOAT) - CAST(bx / 100 AS FLOAT) AS DOUBLE), 2) + pow(CAST(CAST(ay / 100 AS FLOAT) - CAST(byy / 100 AS FLOAT) AS DOUBLE), 2)) END AS deep FROM p),
r AS (SELECT *, CASE WHEN feet THEN c END AS f, shared / (342 - shared) AS iou FROM q),
s AS (SELECT a, b, (least(c / 130, 3) + CASE WHEN f IS NULL THEN 0 ELSE least(f / 150, 3) END + 0.7 * (1 - iou) + 1.2 * CASE WHEN deep IS NULL THEN 0.85 ELSE least(deep / 0.45, 3) END) / 3.9 AS cost FROM r WHERE c <= 130 OR f <= 150 OR iou >= 0.01 OR deep <= 0.45) """


def _sides(spark, d):
    o = detections(spark, d).withColumnRenamed("event_id", "id")
    return o.withColumn("at", F.col("frame") + 1), o.withColumn("at", F.col("frame")), ["label", "at"]


@query(_PAIRS + "SELECT a, b, round(cost, 5) AS cost, round(1 / (1 + cost), 5) AS score FROM s WHERE cost <= 2.85")
def gated_candidates(spark, d):
    """F10, all terms."""
    return tracks.associations(*_sides(spark, d)).select("a", "b", F.round("cost", 5).alias("cost"), F.round(1 / (F.col("cost") + 1), 5).alias("score"))


@query(_PAIRS + ", t AS (SELECT a, b, round(cost, 9) AS cost FROM s WHERE cost <= 2.85) SELECT a, b, round(cost, 5) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS i, row_number() OVER (PARTITION BY b ORDER BY cost, a) AS j FROM t) WHERE i = 1 AND j = 1")
def mutual_nearest(spark, d):
    """Pairs that are each other's best; the first round of any greedy matching."""
    return tracks.mutual_associations(*_sides(spark, d)).select("a", "b", F.round("cost", 5).alias("cost"))


def _clips(spark, d, events=None):
    """Users as clips of 24, so there are the more clips the more users; the order within a frame is the event's number."""
    return detections(spark, d, events).withColumns({"clip_id": F.expr("track_id div 24"), "detection": F.col("event_id")})


@query(None)
def tracklets(spark, d):
    """Greedy, with a memory of one frame. Held against a plain loop in the tests."""
    o = _clips(spark, d).withColumnRenamed("event_id", "id")
    return tracks.previous_frame_tracks(o).withColumn("cost", F.round("cost", 6))


@query(None)
def tracker(spark, d):
    """With predicted points, colours and tracks that outlive gaps. Held against a plain loop in the tests."""
    return tracks.track_clips(_clips(spark, d)).withColumn("cost", F.round("cost", 6))


@query(None)
def tracker_stream(spark, d):
    """I02, I04 on a stream: the events' table as a stream of its files. Held against the table's tracker in the tests."""
    name, store = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, ROCKS)
    try:
        with Scratch(spark) as scratch:
            events = table_stream(spark, d, "events")
            out = scratch.folder + "-kept"
            run = track_stream(_clips(spark, d, events).withColumn("frame", F.col("frame") - FIRST_HOUR)).writeStream.format("parquet").option("path", out)
            run.option("checkpointLocation", f"{scratch.folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            found = spark.read.schema(EVENTS).parquet(out)
    finally:
        spark.conf.set(name, store)
    return found.select("clip_id", (F.col("frame") + FIRST_HOUR).alias("frame"), "detection", "track", F.round("cost", 6).alias("cost"), "gap", "event")


@query(None)
def track_merges(spark, d):
    """Fragments merged until none is left. Held against a plain loop in the tests."""
    o = _clips(spark, d)
    assigned = tracks.track_clips(o)
    members = o.join(assigned.select("clip_id", "frame", "detection", "track"), ["clip_id", "frame", "detection"])
    with Scratch(spark) as scratch:
        # The ends are made of the members in several passes; the tracker is to run once.
        members = scratch.cut(members.select("clip_id", "frame", "detection", "track", "x", "y", "foot_x", "foot_y", "hist"))
        return scratch.keep(tracks.merge_fragments(tracks.track_ends(members)).withColumn("cost", F.round("cost", 6)))


@query(OBS + ", l AS (SELECT track_id, life, min(frame) AS start, max(frame) AS last FROM (SELECT *, sum(CASE WHEN p IS NULL OR frame - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS life FROM (SELECT *, lag(frame) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS p FROM obs)) GROUP BY 1, 2), k AS (SELECT track_id, life, start AS frame, 'track_started' AS event FROM l UNION ALL SELECT track_id, life, (SELECT min(frame) FROM obs WHERE obs.frame > l.last + 5) AS frame, 'track_killed' FROM l) SELECT track_id, CAST(life AS BIGINT) AS life, frame, event FROM k WHERE frame IS NOT NULL")
def track_events(spark, d):
    """The lifecycle events of I02, on lives of users; all hours are frames."""
    o = observations(spark, d)
    lives = tracks.lifecycles(o, 5)
    seen = lives.select(F.lit(0).alias("clip_id"), (F.col("track_id") * 100_000 + F.col("life")).alias("track"), F.explode(F.array("first_frame", "last_frame")).alias("frame"))
    e = tracks.track_events(seen, o.select(F.lit(0).alias("clip_id"), "frame"))
    return e.select(F.expr("track div 100000").alias("track_id"), (F.col("track") % 100_000).alias("life"), "frame", "event")


_ENDS = OBS + """, l AS (SELECT *, sum(CASE WHEN p IS NULL OR frame - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS life FROM (SELECT *, lag(frame) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS p FROM obs)),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, life ORDER BY frame DESC, event_id DESC) AS z, row_number() OVER (PARTITION BY track_id, life ORDER BY frame, event_id) AS s FROM l),
e AS (SELECT track_id, CAST(life AS BIGINT) AS life, min(frame) AS start, max(frame) AS last, max(x) FILTER (s = 1) AS sx, max(y) FILTER (s = 1) AS sy, max(x) FILTER (z = 1) AS zx, max(y) FILTER (z = 1) AS zy, max(x) FILTER (z = 2) AS px, max(y) FILTER (z = 2) AS py, max(frame) FILTER (z = 2) AS pf, avg(x) AS hx, avg(y) AS hy FROM n GROUP BY 1, 2),
c AS (SELECT a.track_id, a.life AS a, b.life AS b, b.start - a.last AS gap, sqrt(pow(a.zx - b.sx, 2) + pow(a.zy - b.sy, 2)) AS d1,
 sqrt(pow(a.zx + coalesce((a.zx - a.px) * (greatest(1, b.start - a.last) / greatest(1, a.last - a.pf)), 0) - b.sx, 2) + pow(a.zy + coalesce((a.zy - a.py) * (greatest(1, b.start - a.last) / greatest(1, a.last - a.pf)), 0) - b.sy, 2)) AS d2,
 (a.hx * b.hx + a.hy * b.hy + 2500) / (sqrt(a.hx * a.hx + a.hy * a.hy + 2500) * sqrt(b.hx * b.hx + b.hy * b.hy + 2500)) AS alike FROM e a JOIN e b ON a.track_id = b.track_id AND b.start - a.last BETWEEN 1 AND 8) """


@query(_ENDS + "SELECT track_id, a, b, gap, round(least(d1, d2) / 170 + 0.08 * gap + 0.35 * (1 - alike), 5) AS cost FROM c WHERE least(d1, d2) <= 170 AND alike >= 0.58")
def fragment_pairs(spark, d):
    """lives of a user (ended by a gap of three hours) that may follow each other."""
    o = observations(spark, d)
    w = Window.partitionBy("track_id").orderBy("frame", "event_id")
    new = F.when(F.lag("frame").over(w).isNull() | (F.col("frame") - F.lag("frame").over(w) > 2), 1).otherwise(0)
    lives = o.withColumn("_new", new).withColumn("track", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.lit(None).cast("double")
    members = lives.select(F.col("track_id").alias("clip_id"), "track", "frame", F.col("event_id").alias("detection"), "x", "y", none.alias("foot_x"), none.alias("foot_y"), F.array("x", "y", F.lit(50.0)).alias("hist"))
    return tracks.fragment_costs(tracks.track_ends(members)).select(F.col("clip_id").alias("track_id"), "a", "b", "gap", F.round("cost", 5).alias("cost"))


@query(OBS + ", l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, greatest(frame - lag(frame) OVER w, 1) AS dt, lead(frame) OVER w AS nf FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)) SELECT event_id, round(x + coalesce((x - px) / dt * greatest(nf - frame, 1), 0) + 0.0000001, 5) AS at_x, round(y + coalesce((y - py) / dt * greatest(nf - frame, 1), 0) + 0.0000001, 5) AS at_y FROM l WHERE nf IS NOT NULL")
def predicted_points(spark, d):
    """Where each point leads at its track's next frame; halves of the last digit are moved off, as engines round them apart."""
    w = Window.partitionBy("track_id").orderBy("frame", "event_id")
    o = observations(spark, d).withColumn("next", F.lead("frame").over(w))
    return tracks.predicted(o, F.col("next")).where("next is not null").select("event_id", F.round(F.col("at_x") + 0.0000001, 5).alias("at_x"), F.round(F.col("at_y") + 0.0000001, 5).alias("at_y"))


_PROJ = OBS + f""", k AS (SELECT unnest({KEYFRAMES}) AS k, unnest(range({len(KEYFRAMES)})) AS i), n AS (SELECT event_id, any_value(o.track_id) AS track_id, any_value(o.frame) AS frame, any_value(x) AS x, any_value(y) AS y, arg_min(k, (abs(o.frame - k), k)) AS keyframe, arg_min(i, (abs(o.frame - k), k)) AS i, min(abs(o.frame - k)) AS distance FROM obs o, k GROUP BY event_id),
w AS (SELECT *, (x * {MATRIX[0][0]} + y * {MATRIX[0][1]} + {MATRIX[0][2]} + 10 * i) / (x * {MATRIX[2][0]} + y * {MATRIX[2][1]} + {MATRIX[2][2]}) AS fx, (x * {MATRIX[1][0]} + y * {MATRIX[1][1]} + {MATRIX[1][2]}) / (x * {MATRIX[2][0]} + y * {MATRIX[2][1]} + {MATRIX[2][2]}) AS fy FROM n),
q AS (SELECT *, fx >= 0 AND fx < 200 AND fy >= 0 AND fy < 80 AS inside FROM w) """


def _projected(spark, d):
    """Every point under the matrix of its nearest keyframe."""
    keys = spark.createDataFrame([(k, [[*MATRIX[0][:2], MATRIX[0][2] + 10 * i], MATRIX[1], MATRIX[2]]) for i, k in enumerate(KEYFRAMES)], "keyframe long, m array<array<double>>")
    o = observations(spark, d).select("event_id", "track_id", "frame", "x", "y")
    near = joins.nearest_join(o, keys.select("keyframe"), "frame", "keyframe", 1 << 40)
    near = near.join(keys, "keyframe")
    m = [[F.col("m")[r][c] for c in range(3)] for r in range(3)]
    fx, fy = projected(F.col("x"), F.col("y"), m)
    p = near.withColumns({"fx": fx, "fy": fy}).drop("m")
    return p.withColumn("inside", (F.col("fx") >= 0) & (F.col("fx") < 200) & (F.col("fy") >= 0) & (F.col("fy") < 80))


@query(_PROJ + "SELECT event_id, keyframe, distance, round(fx, 4) AS field_x, round(fy, 4) AS field_y, inside FROM q")
def projected_points(spark, d):
    """Half-open bounds; points without a foot drop out."""
    return _projected(spark, d).select("event_id", "keyframe", F.col("frame_distance").alias("distance"), F.round("fx", 4).alias("field_x"), F.round("fy", 4).alias("field_y"), "inside")


@query(_PROJ + "SELECT keyframe, count(*) AS points, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS outside, count(DISTINCT frame) AS frames, count(DISTINCT frame) FILTER (distance > 60) AS far_frames FROM q GROUP BY keyframe")
def projection_by_keyframe(spark, d):
    """G17's rollup by keyframe; far means strictly beyond the limit."""
    p = _projected(spark, d)
    return p.groupBy("keyframe").agg(F.count(F.lit(1)).alias("points"), F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"), F.countDistinct("frame").alias("frames"), F.countDistinct(F.when(F.col("frame_distance") > 60, F.col("frame"))).alias("far_frames"))


@query(_PROJ + ", e AS (SELECT track_id, count(*) AS n FROM q GROUP BY track_id HAVING count(*) >= 60) SELECT q.track_id, q.event_id, round(fx, 4) AS field_x, fx <= 16 OR fx >= 184 OR fy <= 6.4 OR fy >= 73.6 AS near_edge FROM q JOIN e ON q.track_id = e.track_id")
def long_track_points(spark, d):
    """E04, E05's test: points of tracks with sixty of them."""
    p = filters.enough_points(_projected(spark, d), 60)
    return p.select("track_id", "event_id", F.round("fx", 4).alias("field_x"), filters.near_edge(F.col("fx"), F.col("fy"), 200.0, 80.0).alias("near_edge"))


@query(OBS + ", g AS (SELECT CAST(round_even(x / 20, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 20, 0) AS BIGINT) AS cell_y, frame // 24 AS frame, count(*) AS n FROM obs GROUP BY 1, 2, 3 HAVING cell_x BETWEEN 0 AND 9 AND cell_y BETWEEN 0 AND 3) SELECT cell_x, cell_y, frame, n, CAST(sum(n) OVER (PARTITION BY cell_x, cell_y ORDER BY frame) AS BIGINT) AS seen FROM g")
def cumulative_cells(spark, d):
    """What has been seen in each cell up to each frame."""
    o = observations(spark, d).select(F.expr("frame div 24").alias("frame"), (F.col("x") / 20).alias("x"), (F.col("y") / 20).alias("y"))
    return spatial.cumulative_cells(o, 10, 4)


@query(OBS + "SELECT DISTINCT frame FROM obs")
def frame_list(spark, d):
    """M10; sorted by whoever shows it."""
    return observations(spark, d).select("frame").distinct()


@query(OBS + ", f AS (SELECT (track_id % 40 - 20) * 5.0 AS a, x / 2 AS b, y AS c, frame, track_id FROM obs), b AS (SELECT *, b BETWEEN 0 AND 200 AND c BETWEEN 0 AND 85 AS ok FROM f) SELECT count(DISTINCT frame) AS frames, count(DISTINCT track_id) AS tracks, count(*) AS points, count(*) FILTER (ok) AS inside, count(*) FILTER (NOT ok) AS outside, round(min(b), 4) AS x_min, round(max(b), 4) AS x_max, round(min(c), 4) AS y_min, round(max(c), 4) AS y_max FROM b")
def feet_summary(spark, d):
    """Closed bounds of the field in feet."""
    return spatial.feet_summary(observations(spark, d).select("frame", "track_id", (F.col("x") / 2).alias("x_ft"), F.col("y").alias("y_ft")), 200.0, 85.0)


@query("SELECT label, round(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY label)), 0), 5) AS value, i AS bin FROM (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(i) GROUP BY label, i)")
def mean_histogram(spark, d):
    """The mean of a track's histograms, scaled to length one."""
    from ..sources import table

    e = table(spark, d, "embeddings").select("label", "embedding")
    return spatial.mean_histograms(e, ["label"], "embedding").select("label", F.posexplode("mean").alias("bin", "value")).select("label", F.round("value", 5).alias("value"), F.col("bin").cast("long").alias("bin"))


@query(OBS + "SELECT track_id, count(*) AS n, count(DISTINCT frame) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, round(avg(CASE WHEN label <> 'error' THEN score END), 6) AS mean_score, bool_or(label = 'purchase') AS any_3d, string_agg(event_id, ',' ORDER BY frame, event_id) AS members FROM obs GROUP BY track_id")
def track_summary(spark, d):
    """Members in order; the array is of one track, whose rows it lists."""
    o = observations(spark, d)
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "event_id"))), lambda s: s["event_id"].cast("string")), ",")
    return o.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.round(F.avg(F.when(F.col("label") != "error", F.col("score"))), 6).alias("mean_score"), F.bool_or(F.col("label") == "purchase").alias("any_3d"), members.alias("members"))
