"""Queries over box geometry, masks, polygons and keyframes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import points as pt
from ..operators import homography
from ..sources import boxes, observations, table
from .catalogue import BOX, FIELD, MATRIX, OBS, query

W, H = 40, 12
#: Boxes that stick out of a frame of 40 x 12 or lie beside it, and images of their own.
RAW = BOX + ", raw AS (SELECT frame, part, box, CAST(x0 AS DOUBLE) - 3 AS x0, CAST(y0 AS DOUBLE) - 2 AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, kind = 'R' AS torso, CAST(part % 50 + 5 AS BIGINT) AS w, CAST(box * 9 + 3 AS BIGINT) AS h, CAST(price AS DOUBLE) AS price FROM box) "


def _raw(spark, d):
    b = boxes(spark, d)
    return b.select("frame", "part", "box", bx.box(F.col("x0") - 3, F.col("y0") - 2, F.col("x1"), F.col("y1")).alias("b"), (F.col("kind") == "R").alias("torso"), (F.col("part") % 50 + 5).cast("long").alias("w"), (F.col("box") * 9 + 3).cast("long").alias("h"), "price")


def _txt(a, b, c, e):
    return "concat_ws(',', " + ", ".join(f"CAST({v} AS BIGINT)" for v in (a, b, c, e)) + ")"


_CUT = "({x0} < 0 OR {y0} < 0 OR {x1} >= 40 OR {y1} >= 12)"


def _cut_sql(x0, y0, x1, y1):
    return _txt(f"greatest(0, {x0})", f"greatest(0, {y0})", f"least(39, {x1})", f"least(11, {y1})"), _CUT.format(x0=x0, y0=y0, x1=x1, y1=y1)


_BW, _BH = "(x1 - x0 + 1)", "(y1 - y0 + 1)"
_PAD = _cut_sql(f"floor(x0 - {_BW} * 0.18)", f"floor(y0 - {_BH} * 0.12)", f"ceil(x1 + {_BW} * 0.18)", f"ceil(y1 + {_BH} * 0.12)")
_TORSO = _cut_sql(f"floor(x0 - {_BW} * 0.08)", f"floor(y0 + {_BH} * 0.16)", f"ceil(x1 + {_BW} * 0.08)", f"ceil(y0 + {_BH} * 0.68)")
_P = f"greatest(2.0, greatest({_BW}, {_BH}) * 0.15)"
_LONG = _cut_sql(f"floor(x0 - {_P})", f"floor(y0 - {_P})", f"ceil(x1 + {_P})", f"ceil(y1 + {_P})")[0]


@query(RAW + f"""SELECT frame, part, box, CASE WHEN nx1 > nx0 AND ny1 > ny0 THEN {_txt('nx0', 'ny0', 'nx1', 'ny1')} END AS normalised, padded, padded_cut, torso_band, torso_cut, longer_side, CAST(floor(margin) AS BIGINT) AS margin FROM (
SELECT *, greatest(0, least(39, floor(x0))) AS nx0, greatest(0, least(11, floor(y0))) AS ny0, greatest(0, least(39, ceil(x1))) AS nx1, greatest(0, least(11, ceil(y1))) AS ny1, {_PAD[0]} AS padded, {_PAD[1]} AS padded_cut, {_TORSO[0]} AS torso_band, {_TORSO[1]} AS torso_cut, {_LONG} AS longer_side, least(floor(x0), floor(y0), 39 - ceil(x1), 11 - ceil(y1)) AS margin FROM raw)""")
def crop_boxes(spark, d):
    """D09 to D13."""
    r, b = _raw(spark, d), F.col("b")
    whole = bx.box(F.floor(b["x0"]), F.floor(b["y0"]), F.ceil(b["x1"]), F.ceil(b["y1"]))
    padded, padded_cut = bx.padded(b, W, H, 0.18, 0.12)
    band, band_cut = bx.torso(b, W, H, 0.08, 0.16, 0.68)
    return r.select("frame", "part", "box", bx.text(bx.normalised(b, W, H)).alias("normalised"), bx.text(padded).alias("padded"), padded_cut.alias("padded_cut"), bx.text(band).alias("torso_band"), band_cut.alias("torso_cut"), bx.text(bx.padded_by_longer_side(b, W, H, 0.15, 2)).alias("longer_side"), bx.border_margin(whole, W, H).alias("margin"))


def _clamp_sql(x0, y0, x1, y1):
    a, b = f"greatest(0, least(w - 1, CAST(floor({x0}) AS BIGINT)))", f"greatest(0, least(h - 1, CAST(floor({y0}) AS BIGINT)))"
    return a, b, f"greatest({a}, least(w - 1, CAST(ceil({x1}) AS BIGINT)))", f"greatest({b}, least(h - 1, CAST(ceil({y1}) AS BIGINT)))"


def _frac_sql(x0, y0, x1, y1):
    return _txt(*_clamp_sql(f"w * CAST({x0} AS DOUBLE)", f"h * CAST({y0} AS DOUBLE)", f"w * CAST({x1} AS DOUBLE) - 1", f"h * CAST({y1} AS DOUBLE) - 1"))


def _fl(side, part):
    return f"CAST(floor({side} * CAST({part} AS DOUBLE)) AS BIGINT)"


def _default_sql(x0, y0, x1, y1):
    return _txt(_fl("w", x0), _fl("h", y0), f"greatest(0, {_fl('w', x1)} - 1)", f"greatest(0, {_fl('h', y1)} - 1)")


def _region_sql(x0, y0, x1, y1):
    a, b = _fl("w", x0), _fl("h", y0)
    return _txt(a, b, f"greatest({a} + 1, least(w, {_fl('w', x1)})) - 1", f"greatest({b} + 1, least(h, {_fl('h', y1)})) - 1")


@query(RAW + f""", k AS (SELECT *, {", ".join(f"{v} AS c{n}" for v, n in zip(_clamp_sql("x0", "y0", "x1", "y1"), ("x0", "y0", "x1", "y1"), strict=True))} FROM raw)
SELECT frame, part, box, {_txt("cx0", "cy0", "cx1", "cy1")} AS clamped, {_frac_sql(0.1, 0.2, 0.8, 0.9)} AS fractional,
CASE WHEN torso THEN {_frac_sql(0.12, 0.06, 0.88, 0.72)} ELSE {_txt(*_clamp_sql("cx0 - CAST(0.16 AS DOUBLE) * (cx1 - cx0 + 1)", "cy0 - CAST(0.14 AS DOUBLE) * (cy1 - cy0 + 1)", "cx1 + CAST(0.16 AS DOUBLE) * (cx1 - cx0 + 1)", "cy1 + CAST(0.18 AS DOUBLE) * (cy1 - cy0 + 1)"))} END AS audit_box,
CASE WHEN torso THEN {_default_sql(0.05, 0.03, 0.95, 0.97)} ELSE {_default_sql(0.10, 0.06, 0.90, 0.68)} END AS default_region,
CASE WHEN torso THEN {_region_sql(0.08, 0.05, 0.92, 0.95)} ELSE {_region_sql(0.12, 0.08, 0.88, 0.66)} END AS number_region FROM k""")
def region_boxes(spark, d):
    """D15 to D17, D36, D37. Torso crops have no guessed box here."""
    r, b, w, h, torso = _raw(spark, d), F.col("b"), F.col("w"), F.col("h"), F.col("torso")
    return r.select("frame", "part", "box", bx.text(bx.clamped(b, w, h)).alias("clamped"), bx.text(bx.fractional(w, h, 0.1, 0.2, 0.8, 0.9)).alias("fractional"), bx.text(bx.padded_audit(F.when(~torso, b), w, h)).alias("audit_box"), bx.text(bx.default_number_region(w, h, torso)).alias("default_region"), bx.text(bx.number_region(w, h, torso)).alias("number_region"))


@query(RAW + """, a AS (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, greatest(0, (x1 - 60) - x0 + 1) * greatest(0, y1 - y0 + 1) AS clamped_area, least(x0, y0) AS border FROM raw)
SELECT frame, part, box, round(area, 4) AS area, round(clamped_area, 4) AS clamped_area, round(area + 10 * least(price / 10, 5000) + 5 * greatest(border, 0), 4) AS crop_rank, round(area + 35 * greatest(border, 0) + CASE WHEN torso THEN 2200 ELSE 0 END + 0.08 * least(price, 12000), 4) AS best_score, CASE WHEN NOT torso THEN concat_ws(',', CAST(floor(x0) AS BIGINT), CAST(ceil(y1) AS BIGINT)) END AS corners FROM a""")
def box_scores(spark, d):
    """D04, D05, D14, C17, C18, D46; the clamped area is that of a box whose right side was moved left."""
    r, b = _raw(spark, d), F.col("b")
    moved = bx.box(b["x0"], b["y0"], b["x1"] - 60, b["y1"])
    border = F.least(b["x0"], b["y0"])
    listed = bx.as_list(F.when(~F.col("torso"), b))
    corners = F.when(listed.isNotNull(), F.concat_ws(",", F.floor(listed[0]).cast("string"), F.ceil(listed[3]).cast("string")))
    return r.select("frame", "part", "box", F.round(bx.area(b), 4).alias("area"), F.round(bx.clamped_area(moved), 4).alias("clamped_area"), F.round(bx.crop_rank(bx.area(b), F.col("price") / 10, border), 4).alias("crop_rank"), F.round(bx.best_crop_score(bx.area(b), border, F.col("torso"), F.col("price")), 4).alias("best_score"), corners.alias("corners"))


_PAIR = RAW + ", p AS (SELECT a.frame, a.part AS a_part, b.part AS b_part, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) AS aa, (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS ba FROM raw a JOIN raw b ON a.frame = b.frame AND a.part < b.part), q AS (SELECT *, CASE WHEN least(ax1, bx1) >= greatest(ax0, bx0) AND least(ay1, by1) >= greatest(ay0, by0) THEN (least(ax1, bx1) - greatest(ax0, bx0) + 1) * (least(ay1, by1) - greatest(ay0, by0) + 1) ELSE 0 END AS shared FROM p) "


@query(_PAIR + "SELECT frame, a_part, b_part, round(least(aa, ba) / greatest(aa, ba), 6) AS size_similarity, round(shared / greatest(aa, 1), 6) AS of_first, round(shared / greatest(ba, 1), 6) AS of_second FROM q")
def box_pair_shares(spark, d):
    """D06, D08, of all pairs of a frame's boxes."""
    r = _raw(spark, d)
    p = r.select("frame", F.col("part").alias("a_part"), F.col("b").alias("a")).join(r.select("frame", F.col("part").alias("b_part"), F.col("b").alias("c")), "frame").where("a_part < b_part")
    a, c = F.col("a"), F.col("c")
    return p.select("frame", "a_part", "b_part", F.round(bx.size_similarity(a, c), 6).alias("size_similarity"), F.round(bx.intersection_fraction(a, c), 6).alias("of_first"), F.round(bx.intersection_fraction(c, a), 6).alias("of_second"))


@query(OBS + "SELECT event_id, round(CASE WHEN x / 400 BETWEEN 0 AND 1 THEN x / 400 * 1600 ELSE x / 400 END, 6) AS px, round(CASE WHEN y BETWEEN 0 AND 1 THEN y * 700 ELSE y END, 6) AS py, round(greatest(0, least(1, x / 100 - 0.5)), 6) AS share, coalesce(y >= 0.82 * x AND y >= 0.68 * (x / 2) AND y >= 35, false) AS green, CASE CAST(y AS BIGINT) % 4 WHEN 0 THEN x WHEN 1 THEN y END AS element, round(CASE WHEN label <> 'error' THEN sqrt(CAST(CAST(CAST(x AS FLOAT) - CAST(y AS FLOAT) AS FLOAT) AS DOUBLE) * CAST(CAST(CAST(x AS FLOAT) - CAST(y AS FLOAT) AS FLOAT) AS DOUBLE) + 9 + 16) END, 3) AS distance, ['red', 'green', 'blue'][((track_id - 1) % 3 + 3) % 3 + 1] AS colour FROM obs")
def point_scalars(spark, d):
    """D02, D21, D24, D25's rule, D38, D53. """
    x, y = F.col("x"), F.col("y")
    element = pt.element(F.array(x, y), y.cast("long") % 4)
    far = pt.distance_3d(F.array(x, F.lit(3.0), F.lit(4.0)), F.when(F.col("label") != "error", F.array(y, F.lit(0.0), F.lit(0.0))))
    return observations(spark, d).select("event_id", F.round(pt.to_pixels(x / 400, F.lit(1600)), 6).alias("px"), F.round(pt.to_pixels(y, F.lit(700)), 6).alias("py"), F.round(pt.clipped(x / 100 - 0.5), 6).alias("share"), pt.is_green(x, y, x / 2).alias("green"), element.alias("element"), F.round(far, 3).alias("distance"), pt.palette(F.col("track_id"), ["red", "green", "blue"]).alias("colour"))


_CORNERS = ";".join(f"{x / 500},{y / 100}" for x, y in FIELD)
_VALUES = ", ".join(f"({x0}, {y0}, {x1}, {y1})" for (x0, y0), (x1, y1) in zip(FIELD, FIELD[1:] + FIELD[:1], strict=True))


@query(OBS + f"SELECT event_id, count(*) FILTER (((e.y0 > o.y) <> (e.y1 > o.y)) AND o.x < ((e.x1 - e.x0) * (o.y - e.y0)) / (e.y1 - e.y0) + e.x0) % 2 = 1 AS inside, count(*) FILTER (((e.y0 > o.y) <> (e.y1 > o.y)) AND o.x < ((e.x1 - e.x0) * (o.y - e.y0)) / (e.y1 - e.y0) + e.x0) % 2 = 1 AS inside_json FROM obs o, (VALUES {_VALUES}) e(x0, y0, x1, y1) GROUP BY event_id")
def polygon_text(spark, d):
    """A18, A19, D22, D23 on the polygon as text, in parts of 500 x 100, and as JSON."""
    o = observations(spark, d)
    plain = pt.polygon_pixels(pt.parse_polygon(F.lit(_CORNERS + "; ")), F.lit(500.0), F.lit(100.0))
    pairs = "[" + ",".join(f"[{x / 500}, {y / 100}]" for x, y in FIELD) + "]"
    known = pt.polygon_pixels(pt.parse_polygon_json(F.lit('{"polygon": ' + pairs + "}")), F.lit(500.0), F.lit(100.0))
    # The texts are read once, not for every point.
    parsed = F.broadcast(spark.range(1).select(plain.alias("plain"), known.alias("known")))
    return o.crossJoin(parsed).select("event_id", pt.inside_polygon(F.col("x"), F.col("y"), F.col("plain")).alias("inside"), pt.inside_polygon(F.col("x"), F.col("y"), F.col("known")).alias("inside_json"))


_MASK = OBS + """, px AS (SELECT track_id, frame // 24 AS frame, CAST(floor(x) AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM obs), m AS (SELECT track_id, frame, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY 1, 2),
f AS (SELECT m.*, (SELECT avg(x) FROM px WHERE px.track_id = m.track_id AND px.frame = m.frame AND px.y >= greatest(0, m.y1 - 2)) AS fx FROM m) """


def _masks(spark, d):
    px = observations(spark, d).select("track_id", F.expr("frame div 24").alias("frame"), F.floor("x").alias("x"), F.col("y").cast("long").alias("y"))
    return pt.mask_shapes(px, ["track_id", "frame"])


@query(_MASK + "SELECT track_id, frame, area, concat_ws(',', x0, y0, x1, y1) AS box, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y, round(fx, 4) AS foot_x, y1 AS foot_y, y0 <= 18 AS touches_bench FROM f")
def mask_shapes(spark, d):
    """The events of a user and a day as the pixels of a mask."""
    b = bx.box(*[F.col(c) for c in bx.SIDES])
    return _masks(spark, d).select("track_id", "frame", "area", bx.text(b).alias("box"), F.round("centroid_x", 4).alias("centroid_x"), F.round("centroid_y", 4).alias("centroid_y"), F.round("foot_x", 4).alias("foot_x"), F.col("foot_y").cast("long").alias("foot_y"), (F.col("y0") <= 18).alias("touches_bench"))


_POLY = f"(SELECT count(*) % 2 = 1 FROM (VALUES {_VALUES}) e(x0, y0, x1, y1) WHERE ((e.y0 > f.y1) <> (e.y1 > f.y1)) AND f.fx < ((e.x1 - e.x0) * (f.y1 - e.y0)) / (e.y1 - e.y0) + e.x0)"
_MODES = ("y_threshold", "field_polygon", "green_foot_point", "combined")


@query(_MASK + ", g AS (SELECT *, " + _POLY + " AS poly FROM f) SELECT track_id, frame, mode, surface, concat_ws(';', CASE WHEN area < 2 THEN 'too_small' END, CASE WHEN cy < 18 THEN 'centroid_in_bench_strip' END, CASE WHEN mode IN ('y_threshold', 'combined') AND y1 < 36 THEN 'bottom_point_above_field_cutoff' END, CASE WHEN mode IN ('field_polygon', 'combined') AND surface AND NOT poly THEN 'bottom_point_outside_field_polygon' WHEN mode IN ('field_polygon', 'combined') AND NOT surface AND y1 NOT BETWEEN 36 AND 90 THEN 'bottom_point_outside_field_y_band' END, CASE WHEN mode = 'green_foot_point' AND NOT (cx >= 60) THEN 'foot_point_not_on_green_surface' END) AS reasons FROM g, (SELECT unnest(" + str(list(_MODES)) + ") AS mode), (SELECT unnest([true, false]) AS surface)")
def mask_rules(spark, d):
    """E02 in its four modes, with and without a polygon; green stands for a wide centroid here."""
    from ..operators import filters

    m = _masks(spark, d).withColumns({"mode": F.explode(F.array(*[F.lit(x) for x in _MODES])), "green": F.col("centroid_x") >= 60})
    m = m.withColumn("surface", F.explode(F.array(F.lit(True), F.lit(False))))
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in FIELD])
    inside = F.when(F.col("surface"), pt.inside_polygon(F.col("foot_x"), F.col("foot_y"), corners))
    why = filters.mask_reasons(F.col("mode"), F.col("area"), F.col("centroid_y"), F.col("foot_y"), inside, F.col("surface"), F.col("green"), bench=18, low=36, high=90, least=2)
    return m.select("track_id", "frame", "mode", "surface", F.array_join(why, ";").alias("reasons"))


_KEY = RAW + ", k AS (SELECT frame, string_agg(DISTINCT CAST(part AS VARCHAR), ',') AS x, list([x0, y0] ORDER BY part, box, x0, y0) AS v, list(CASE WHEN box = 3 THEN [0.0, 0.0] ELSE [x1, y1] END ORDER BY part, box, x0, y0) AS f, list('p' || (part % 9) ORDER BY part, box, x0, y0) AS names FROM raw GROUP BY frame) "


def _keyframes(spark, d):
    b = F.col("b")
    rows = _raw(spark, d).select("frame", F.struct("part", "box", b["x0"].alias("x0"), b["y0"].alias("y0"), F.array(b["x0"], b["y0"]).alias("v"), F.when(F.col("box") == 3, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(b["x1"], b["y1"])).alias("f"), F.concat(F.lit("p"), (F.col("part") % 9).cast("string")).alias("name")).alias("s"))
    k = rows.groupBy("frame").agg(F.sort_array(F.collect_list("s")).alias("s"))  # the boxes of one order: seven at most
    return k.select("frame", pt.zipped_points(F.transform("s", lambda s: s["name"]), F.transform("s", lambda s: s["v"]), F.transform("s", lambda s: s["f"])).alias("points"))


@query(_KEY + """, u AS (SELECT frame, names, v, f, unnest(range(1, len(v) + 1)) AS i FROM k), e AS (SELECT frame, i, names[i] AS n, names[:i - 1] AS before, v[i] = [0.0, 0.0] AS vz, f[i] = [0.0, 0.0] AS fz FROM u)
SELECT k.frame, len(v) AS n_points, array_to_string(names, ',') AS names, (CASE WHEN len(v) < 4 THEN 1 ELSE 0 END) + (SELECT count(*) FILTER (list_contains(before, n)) + count(*) FILTER (vz) + count(*) FILTER (fz) FROM e WHERE e.frame = k.frame) AS errors,
coalesce(CASE WHEN len(v) < 4 THEN 'frame_' || k.frame || ' needs at least 4 point correspondences; found ' || len(v) || '.' END, (SELECT min_by(CASE WHEN list_contains(before, n) THEN 'frame_' || e.frame || ' has duplicate calibration point name: ' || n ELSE 'frame_' || e.frame || ':' || n || CASE WHEN vz THEN ' video_xy' ELSE ' field_xy' END || ' is still placeholder [0, 0].' END, i) FROM e WHERE e.frame = k.frame AND (list_contains(before, n) OR vz OR fz))) AS first_error FROM k""")
def keyframe_errors(spark, d):
    """Every order as a keyframe."""
    names, video, _ = pt.unzipped_points(F.col("points"))
    errors = pt.point_errors(F.concat(F.lit("frame_"), F.col("frame").cast("string")), F.col("points"), 4)
    return _keyframes(spark, d).select("frame", F.size(video).cast("long").alias("n_points"), F.array_join(names, ",").alias("names"), F.size(errors).cast("long").alias("errors"), F.try_element_at(errors, F.lit(1)).alias("first_error"))


@query(OBS + f", k AS (SELECT frame % 7 AS keyframe, count(*) AS points FROM obs GROUP BY 1) SELECT keyframe, points, i AS cell, round(CASE WHEN i = 2 THEN {MATRIX[0][2]} + keyframe ELSE m END, 2) AS value FROM k, (SELECT unnest({[c for r in MATRIX for c in r]}) AS m, unnest(range(9)) AS i)")
def homography_fit(spark, d):
    """The matrix that each keyframe's points were made with comes back."""
    from ..functions import projected

    o = observations(spark, d).select((F.col("frame") % 7).alias("keyframe"), "x", "y")
    w = F.col("x") * MATRIX[2][0] + F.col("y") * MATRIX[2][1] + MATRIX[2][2]
    px, py = projected(F.col("x"), F.col("y"), MATRIX)
    pairs = o.select("keyframe", "x", "y", (px + F.col("keyframe") / w).alias("u"), py.alias("v"))
    fit = homography.fit(pairs, ["keyframe"])
    return fit.select("keyframe", "points", F.posexplode("matrix").alias("cell", "value")).select("keyframe", "points", F.col("cell").cast("long"), F.round("value", 2).alias("value"))


@query("SELECT p_partkey, p_size, p_size % 2 = 0 AND p_size > 10 AS known, CASE WHEN p_size % 2 = 0 AND p_size > 10 THEN 'written' ELSE 'missing' END AS status FROM part")
def path_status(spark, d):
    """Paths held against a listing."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    there = p.where("p_size % 2 = 0 and p_size > 10").select(F.col("p_size").alias("path")).distinct()
    return p.join(there, F.col("p_size") == F.col("path"), "left").select("p_partkey", "p_size", F.col("path").isNotNull().alias("known"), F.when(F.col("path").isNotNull(), "written").otherwise("missing").alias("status"))
