"""One query per operator, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from .. import streaming
from ..functions import boxes as bx
from ..operators import joins, select, spatial, tracks, votes
from ..sources import boxes, observations, roster, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS = "WITH obs AS (SELECT user_id AS track_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_id, event_type AS label, value AS score, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events) "
BOX = "WITH box AS (SELECT l_orderkey AS frame, l_linenumber AS box, l_partkey AS part, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + l_tax * 100 + 1 AS x1, l_discount * 100 + l_linenumber AS y1, l_extendedprice AS price, l_returnflag AS kind FROM lineitem) "
ROSTER = "WITH roster AS (SELECT c_nationkey AS team, CAST(c_custkey % 100 AS INTEGER) AS number, c_name AS name, c_custkey AS player_id FROM customer) "
FIELD = [(50.0, 10.0), (400.0, 20.0), (450.0, 80.0), (100.0, 90.0)]
MATRIX = [[1.1, 0.02, 5.0], [0.01, 0.9, 3.0], [0.0001, 0.0002, 1.0]]
KEYFRAMES = [473354, 473400, 473500, 473700, 473900]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _six(c, d: int = 6):
    return F.round(c, d)


@query(OBS + """, t AS (SELECT track_id, count(*) AS n, avg(CASE WHEN label = 'error' THEN 0 ELSE least(score / 100, 1) END) AS m, max(CASE WHEN label = 'purchase' THEN score / 500 ELSE 0 END) AS r, max(CASE WHEN label = 'view' THEN y / 150 ELSE 0 END) AS b FROM obs GROUP BY track_id)
SELECT track_id, n, round(m, 6) AS mean_overlap, concat_ws(';', CASE WHEN n < 50 THEN 'track_too_short' END, CASE WHEN m < 0.25 THEN 'insufficient_playing_surface_overlap' END, CASE WHEN r >= 0.5 THEN 'referee_rejection' END, CASE WHEN b >= 0.5 THEN 'bench_crowd_suppression' END) AS reasons, (n >= 50 AND m >= 0.25 AND r < 0.5 AND b < 0.5) AS kept FROM t""")
def active_filter(spark, d):
    """E01, L07."""
    of = lambda label, v: F.when(F.col("label") == label, v).otherwise(0.0)
    o = observations(spark, d).select("track_id", F.when(F.col("label") != "error", F.least(F.col("score") / 100, F.lit(1.0))).alias("overlap"), of("purchase", F.col("score") / 500).alias("referee"), of("view", F.col("y") / 150).alias("bench"))
    return select.active_tracks(o, least=50).select("track_id", "n", _six("mean_overlap").alias("mean_overlap"), F.array_join("reasons", ";").alias("reasons"), "kept")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_filter(spark, sf_dir)


@query(OBS + "SELECT track_id, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) - 1 AS position FROM obs) WHERE position % 5 = 0 AND position < 50")
def frame_stride(spark, d):
    return select.strided(observations(spark, d), ["track_id"], ["frame", "event_id"], 5, 10).select("track_id", "event_id", F.col("position").cast("long"))


@query(OBS + "SELECT track_id, frame, event_id FROM obs WHERE frame BETWEEN 473400 AND 473500 AND frame % 3 = 0")
def clip_slice(spark, d):
    return observations(spark, d).where(F.col("frame").between(473400, 473500) & (F.col("frame") % 3 == 0)).select("track_id", "frame", "event_id")


@query(OBS + """, p AS (SELECT track_id, event_id, row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) - 1 AS position, count(*) OVER (PARTITION BY track_id) AS n FROM obs)
SELECT track_id, event_id, position FROM p WHERE n <= 8 OR position IN (SELECT CAST(round_even(k * (p.n - 1) / 7.0, 0) AS BIGINT) FROM range(8) r(k))""")
def even_sample(spark, d):
    return select.evenly_sampled(observations(spark, d), ["track_id"], ["frame", "event_id"], 8).select("track_id", "event_id", F.col("position").cast("long"))


@query(OBS + "SELECT track_id, frame, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY score DESC, event_id) AS o FROM obs) WHERE o = 1 QUALIFY rank <= 4")
def topk_unique_frames(spark, d):
    return select.top_n_distinct(observations(spark, d), ["track_id"], "frame", [F.desc("score"), F.col("event_id")], 4).select("track_id", "frame", "event_id", "rank")


@query(OBS + "SELECT track_id, label, event_id, CAST(row_number() OVER (PARTITION BY track_id, label ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM obs QUALIFY rank <= 3")
def topn_per_type(spark, d):
    return select.top_n(observations(spark, d), ["track_id", "label"], [F.desc("score"), F.col("event_id")], 3).select("track_id", "label", "event_id", "rank")


@query(OBS + "SELECT track_id, frame, arg_max(label, (score, -event_id)) AS label, max(score) AS score FROM obs GROUP BY track_id, frame")
def argmax_variant(spark, d):
    best = F.max_by("label", F.struct("score", (-F.col("event_id")).alias("o")))
    return observations(spark, d).groupBy("track_id", "frame").agg(best.alias("label"), F.max("score").alias("score"))


_IOU = """, p AS (SELECT a.frame, a.part AS a_part, b.part AS b_part, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) AS o,
 (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) + (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS s FROM box a JOIN box b ON a.frame = b.frame AND a.part < b.part) """


def _box_pairs(spark, d):
    """Boxes of a frame that share an area, by the cells they cover."""
    b = boxes(spark, d).select("frame", "part", bx.box(*[F.col(c) for c in bx.SIDES]).alias("box"))
    a, c = (b.select("frame", F.col("part").alias(f"{p}_part"), F.col("box").alias(f"{p}_box")) for p in "ab")
    return joins.touching_join(a, c, ["frame"], "a_box", "b_box", 256.0).where("a_part < b_part").withColumn("iou", bx.iou(F.col("a_box"), F.col("b_box")))


@query(BOX + _IOU + "SELECT frame, a_part, b_part, round(o / (s - o), 6) AS iou FROM p WHERE o / (s - o) >= 0.01")
def iou_pairs(spark, d):
    return _box_pairs(spark, d).where("iou >= 0.01").select("frame", "a_part", "b_part", _six("iou").alias("iou"))


@query(OBS + ", b AS (SELECT event_id, frame, label, x / 5 AS x0, y AS y0, x / 5 + 9 AS x1, y + 14 AS y1 FROM obs), n AS (SELECT event_id, frame, label, greatest(0, least(89, floor(x0))) AS x0, greatest(0, least(99, floor(y0))) AS y0, greatest(0, least(89, ceil(x1))) AS x1, greatest(0, least(99, ceil(y1))) AS y1 FROM b), v AS (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM n) "
       "SELECT a.event_id, round(CASE WHEN NOT a.ok THEN 1.0 ELSE coalesce(max(CASE WHEN o.ok AND least(a.x1, o.x1) >= greatest(a.x0, o.x0) AND least(a.y1, o.y1) >= greatest(a.y0, o.y0) THEN (least(a.x1, o.x1) - greatest(a.x0, o.x0) + 1) * (least(a.y1, o.y1) - greatest(a.y0, o.y0) + 1) / greatest((a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1), 1) WHEN o.ok THEN 0 END), 0.0) END, 6) AS overlap FROM v a LEFT JOIN v o ON a.frame = o.frame AND a.label = o.label AND a.event_id <> o.event_id GROUP BY a.event_id, a.ok")
def overlap_max(spark, d):
    """the largest share of a box that another of its frame covers. Frames are hours and labels here."""
    o = observations(spark, d)
    b = o.select("event_id", "frame", "label", bx.box(F.col("x") / 5, F.col("y"), F.col("x") / 5 + 9, F.col("y") + 14).alias("b"))
    return joins.largest_overlap(b, "event_id", ["frame", "label"], "b", 90, 100).select("event_id", _six("overlap").alias("overlap"))


@query(OBS + ", l AS (SELECT *, sum(CASE WHEN p IS NULL OR frame - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS life FROM (SELECT *, lag(frame) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS p FROM obs)) SELECT track_id, CAST(life AS BIGINT) AS life, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM l GROUP BY track_id, life")
def lifecycle(spark, d):
    return tracks.lifecycles(observations(spark, d), 5)


_LAG = OBS + ", l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, greatest(frame - lag(frame) OVER w, 1) AS dt FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)) "


@query(_LAG + "SELECT event_id, round((x - px) / dt, 6) AS vx, round((y - py) / dt, 6) AS vy FROM l WHERE px IS NOT NULL")
def velocity(spark, d):
    return tracks.motion(observations(spark, d)).where("vx is not null").select("event_id", _six("vx").alias("vx"), _six("vy").alias("vy"))


@query(_LAG + "SELECT event_id, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS step FROM l")
def step_distance(spark, d):
    return tracks.motion(observations(spark, d)).select("event_id", _six("step").alias("step"))


@query(OBS + "SELECT event_id, count(*) OVER (PARTITION BY track_id ORDER BY frame RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS trail FROM obs")
def trail_range(spark, d):
    return observations(spark, d).select("event_id", F.count(F.lit(1)).over(Window.partitionBy("track_id").orderBy("frame").rangeBetween(-7, 0)).alias("trail"))


@query(OBS + ", c AS (SELECT frame, count(*) AS n FROM obs GROUP BY frame) SELECT frame, n, CAST(sum(n) OVER (ORDER BY frame) AS BIGINT) AS seen FROM c")
def cumulative_points(spark, d):
    return spatial.cumulative(observations(spark, d))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def appearance_cosine(spark, d):
    e = table(spark, d, "embeddings")
    a = e.select((F.col("vec_id") + 1).alias("b"), F.col("vec_id").alias("a"), F.col("embedding").alias("e"))
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("f"))
    return a.join(b, "b").select("a", "b", F.round(fn.cosine(F.col("e"), F.col("f")), 5).alias("cosine"))


def _edges() -> str:
    return ", ".join(f"({x0}, {y0}, {x1}, {y1})" for (x0, y0), (x1, y1) in zip(FIELD, FIELD[1:] + FIELD[:1], strict=True))


@query(OBS + f"SELECT event_id, count(*) FILTER (((e.y0 > o.y) <> (e.y1 > o.y)) AND o.x < ((e.x1 - e.x0) / (e.y1 - e.y0)) * (o.y - e.y0) + e.x0) % 2 = 1 AS inside FROM obs o, (VALUES {_edges()}) e(x0, y0, x1, y1) GROUP BY event_id")
def point_in_polygon(spark, d):
    return observations(spark, d).select("event_id", fn.in_polygon(F.col("x"), F.col("y"), FIELD).alias("inside"))


@query(OBS + "SELECT event_id, round((x * 1.1 + y * 0.02 + 5) / (x * 0.0001 + y * 0.0002 + 1), 4) AS px, round((x * 0.01 + y * 0.9 + 3) / (x * 0.0001 + y * 0.0002 + 1), 4) AS py FROM obs")
def homography_apply(spark, d):
    px, py = fn.projected(F.col("x"), F.col("y"), MATRIX)
    return observations(spark, d).select("event_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query(OBS + f", k AS (SELECT unnest({KEYFRAMES}) AS k) SELECT event_id, CASE WHEN min(abs(frame - k)) <= 60 THEN arg_min(k, (abs(frame - k), k)) END AS keyframe, min(abs(frame - k)) AS frame_distance FROM obs, k GROUP BY event_id")
def nearest_keyframe(spark, d):
    k = spark.createDataFrame([(x,) for x in KEYFRAMES], "key long")
    return joins.nearest_join(observations(spark, d).select("event_id", "frame"), k, "frame", "key", 60).select("event_id", "keyframe", "frame_distance")


@query(OBS + "SELECT frame, count(*) AS points, count(*) FILTER (x >= 0 AND x < 100 AND y >= 0 AND y < 50) AS inside FROM obs GROUP BY frame")
def projection_by_frame(spark, d):
    return observations(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.expr("x >= 0 and x < 100 and y >= 0 and y < 50")).alias("inside"))


_GRID = OBS + ", g AS (SELECT CAST(round_even(x, 0) AS BIGINT) AS cell_x, CAST(round_even(y, 0) AS BIGINT) AS cell_y, count(*) AS n FROM obs GROUP BY 1, 2 HAVING cell_x BETWEEN 0 AND 119 AND cell_y BETWEEN 0 AND 79) "


@query(_GRID + "SELECT * FROM g")
def density_grid(spark, d):
    return spatial.density(observations(spark, d), 120, 80)


@query(_GRID + "SELECT cell_x, cell_y, n, CAST(floor(least(255.0, n * 255.0 / (SELECT max(n) FROM g))) AS BIGINT) AS level FROM g")
def density_norm(spark, d):
    return spatial.normalised(spatial.density(observations(spark, d), 120, 80))


_BLUR = "SELECT CAST(dx AS BIGINT) AS d, exp(-(dx * dx) / 8.0) / (SELECT sum(exp(-(e * e) / 8.0)) FROM range(-6, 7) q(e)) AS w FROM range(-6, 7) r(dx)"


@query(_GRID + f", k AS ({_BLUR}), xs AS (SELECT CAST(i AS BIGINT) AS i FROM range(120) r(i)), ys AS (SELECT CAST(i AS BIGINT) AS i FROM range(80) r(i)), a AS (SELECT xs.i AS cell_x, g.cell_y, sum(g.n * k.w) AS n FROM xs JOIN k ON true JOIN g ON g.cell_x = greatest(0, least(119, xs.i + k.d)) GROUP BY 1, 2), b AS (SELECT a.cell_x, ys.i AS cell_y, sum(a.n * k.w) AS smooth FROM ys JOIN k ON true JOIN a ON a.cell_y = greatest(0, least(79, ys.i + k.d)) GROUP BY 1, 2) SELECT cell_x, cell_y, round(smooth, 5) AS smooth FROM b")
def gaussian_2d(spark, d):
    """G21, with replicated borders."""
    return spatial.smoothed_field(spatial.density(observations(spark, d), 120, 80), 120, 80, 2.0, 6).select("cell_x", "cell_y", F.round("smooth", 5).alias("smooth"))


@query(OBS + ", m AS (SELECT track_id, avg(score) AS s FROM obs GROUP BY track_id), b AS (SELECT coalesce(median(s), 80) AS base FROM m) SELECT track_id, round(s, 6) AS mean_score, s < least(55, 0.65 * base) AS low FROM m, b")
def saturation_median(spark, d):
    m = observations(spark, d).groupBy("track_id").agg(F.avg("score").alias("s"))
    base = m.agg(F.coalesce(F.median("s"), F.lit(80.0)).alias("base"))  # one row
    return m.crossJoin(F.broadcast(base)).select("track_id", _six("s").alias("mean_score"), (F.col("s") < F.least(F.lit(55.0), F.col("base") * 0.65)).alias("low"))


@query("WITH l(label) AS (VALUES ('click'), ('error'), ('purchase'), ('view'), ('unseen')) SELECT l.label, count(event_id) AS n FROM l LEFT JOIN events e ON e.event_type = l.label GROUP BY l.label")
def label_counts_zero(spark, d):
    wanted = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "view", "unseen")], "label string")
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("event_id").alias("_n"))
    return wanted.join(counts, wanted.label == counts.event_type, "left").select("label", F.coalesce("_n", F.lit(0)).alias("n"))


@query(BOX + "SELECT frame, part, box, round(0.25 * least(1, (y1 - y0 + 1) / 8) + 0.24 * (x0 / (x0 + 140)) + 0.18 * (price / (price + 1800)) + 0.18 * least(1, (x1 - x0) / 10) + 0.10 * (1 - y0 / 10) + 0.05, 6) AS quality FROM box")
def crop_quality(spark, d):
    q = fn.crop_quality(F.least(F.lit(1.0), (F.col("y1") - F.col("y0") + 1) / 8), F.col("x0") / (F.col("x0") + 140), F.col("price") / (F.col("price") + 1800), F.least(F.lit(1.0), (F.col("x1") - F.col("x0")) / 10), 1 - F.col("y0") / 10, F.lit(1.0))
    return boxes(spark, d).select("frame", "part", "box", _six(q).alias("quality"))


@query("SELECT doc_id, coalesce(quality, 0) AS quality, quality IS NOT NULL AS audited FROM documents LEFT JOIN labels USING (doc_id)")
def clean_audit_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("quality").isNotNull().alias("audited"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def audit_unmatched(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(OBS + ", a AS (SELECT track_id, frame, max(score) AS e FROM obs WHERE label = 'purchase' GROUP BY 1, 2), b AS (SELECT track_id, max(score) AS l FROM obs WHERE label = 'view' GROUP BY 1) SELECT o.event_id, coalesce(a.e, b.l) AS evidence FROM obs o LEFT JOIN a ON o.track_id = a.track_id AND o.frame = a.frame LEFT JOIN b ON o.track_id = b.track_id")
def nested_evidence(spark, d):
    o = observations(spark, d)
    a = o.where("label = 'purchase'").groupBy("track_id", "frame").agg(F.max("score").alias("evidence"))
    b = o.where("label = 'view'").groupBy("track_id").agg(F.max("score").alias("evidence"))
    return joins.fallback_join(o, a, b, ["track_id", "frame"], ["track_id"], "evidence").select("event_id", "evidence")


@query("SELECT p_partkey, nullif(regexp_replace(p_brand, '[^0-9]', '', 'g'), '') AS digits FROM part")
def digits_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.digits(F.col("p_brand")).alias("digits"))


@query(ROSTER + "SELECT number, count(*) AS players, count(DISTINCT team) AS teams, count(*) > 1 AS ambiguous FROM roster GROUP BY number")
def roster_index(spark, d):
    return votes.roster_index(roster(spark, d))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id")
def id_reconcile(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"))
    b = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("doc_id"), F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both").alias("side"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_except(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query(OBS + ", s AS (SELECT label, 4 * count(*) FILTER (x BETWEEN 4 AND 96 AND y BETWEEN 18 AND 94) + 0.7 * count(*) + avg(score) - 2 * count(*) FILTER (y < 18 OR x < 4 OR x > 96) AS p FROM obs GROUP BY label) SELECT label, round(p, 4) AS prompt_score, CAST(row_number() OVER (ORDER BY p DESC, label) AS INTEGER) AS rank FROM s")
def prompt_rank(spark, d):
    p = F.count_if(F.expr("x between 4 and 96 and y between 18 and 94")) * 4 + F.count(F.lit(1)) * 0.7 + F.avg("score") - F.count_if(F.expr("y < 18 or x < 4 or x > 96")) * 2
    return observations(spark, d).groupBy("label").agg(p.alias("p")).select("label", F.round("p", 4).alias("prompt_score"), F.row_number().over(Window.orderBy(F.desc("p"), "label")).alias("rank"))


@query(OBS + "SELECT event_id, round((x + 100) / 200 * 1600, 4) AS field_x, round((85 - y) / 85 * 700, 4) AS field_y_up, (x BETWEEN -100 AND 100) AND (y BETWEEN 0 AND 85) AS in_bounds FROM obs")
def feet_transform(spark, d):
    x, _ = fn.feet_to_field(F.col("x"), F.lit(0.0), origin="center")
    _, y = fn.feet_to_field(F.col("x"), F.col("y"), origin="bottom_left")
    return observations(spark, d).select("event_id", F.round(x, 4).alias("field_x"), F.round(y, 4).alias("field_y_up"), (F.col("x").between(-100, 100) & F.col("y").between(0, 85)).alias("in_bounds"))


@query(OBS + "SELECT label, count(*) FILTER (isfinite(x) AND score > 20) AS strict, count(*) FILTER (isfinite(x) AND score >= 20) AS loose, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(var_pop(x), 4) AS x_var FROM obs GROUP BY label")
def point_stats(spark, d):
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    return observations(spark, d).groupBy("label").agg(F.count_if(finite & (F.col("score") > 20)).alias("strict"), F.count_if(finite & (F.col("score") >= 20)).alias("loose"), _six(F.min("x")).alias("x_min"), _six(F.max("x")).alias("x_max"), F.round(F.var_pop("x"), 4).alias("x_var"))


@query(OBS + ", f AS (SELECT frame, count(*) AS n, count(*) FILTER (label = 'purchase') AS p FROM obs GROUP BY frame) SELECT frame, n AS detected, p AS rendered, greatest(0, n - p) AS missing FROM f")
def frame_accounting(spark, d):
    return observations(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("detected"), F.count_if(F.col("label") == "purchase").alias("rendered")).withColumn("missing", F.greatest(F.lit(0), F.col("detected") - F.col("rendered")))


@query("SELECT p_partkey, variant, p_partkey || '_' || variant AS region_id FROM part, (SELECT unnest(['raw', 'gray', 'contrast', 'sharp', 'threshold', 'inverted', 'scaled', 'tight']) AS variant)")
def variant_explode(spark, d):
    names = F.array(*[F.lit(v) for v in ("raw", "gray", "contrast", "sharp", "threshold", "inverted", "scaled", "tight")])
    return table(spark, d, "part").select("p_partkey", F.explode(names).alias("variant")).withColumn("region_id", F.concat_ws("_", F.col("p_partkey").cast("string"), "variant"))


@query("SELECT page_id, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def blob_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, d):
    own = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return own.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "role"))), lambda s: s["role"]), ",").alias("roles"))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return streaming.windowed_counts(table(spark, d, "events"))


@query(OBS + "SELECT frame, x, y, label FROM obs UNION ALL SELECT frame, x, y, 'copy' FROM obs WHERE score > 50")
def union_points(spark, d):
    o = observations(spark, d)
    return o.select("frame", "x", "y", "label").unionByName(o.where("score > 50").select("frame", "x", "y", F.lit("copy").alias("label")))
