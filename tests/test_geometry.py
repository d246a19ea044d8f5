import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackloom.functions import boxes as bx
from trackloom.functions import points as pt
from trackloom.functions import text as tx
from trackloom.operators import crops, homography, joins, select, spatial


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_missing_boxes(spark):
    none = F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
    b = bx.box(*[F.lit(float(v)) for v in (2, 3, 5, 9)])
    assert _one(spark, bx.area(b), bx.area(none), bx.size_similarity(b, none), bx.iou(b, none), bx.iou(b, b)) == (28.0, None, None, 0.0, 1.0)
    assert _one(spark, bx.normalised(none, 10, 10), bx.normalised(bx.box(*[F.lit(float(v)) for v in (12, 3, 15, 9)]), 10, 10)) == (None, None)
    assert _one(spark, bx.as_list(none), bx.text(none), bx.border_margin(none, 10, 10)) == (None, None, None)
    flat = bx.box(*[F.lit(float(v)) for v in (5, 5, 3, 3)])
    assert _one(spark, bx.clamped_area(flat), bx.overlap(flat, b)) == (0.0, 0.0)


def test_polygons(spark):
    square = pt.parse_polygon(F.lit("0,0;4,0; ;4,4;0,4"))
    named = pt.parse_polygon_json(F.lit('{"points": [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 4}, {"x": 0, "y": 4}]}'))
    at = lambda x, y: (F.lit(x).cast("double"), F.lit(y).cast("double"))
    assert _one(spark, *[pt.inside_polygon(*at(x, y), p) for p in (square, named) for x, y in ((1, 1), (5, 1), (-1, 2))]) == (True, False, False) * 2
    assert _one(spark, pt.inside_polygon(*at(None, 1), square), pt.parse_polygon(F.lit(" ; ")), pt.inside_polygon(*at(1, 1), pt.parse_polygon(F.lit("")))) == (None, None, None)
    assert _one(spark, pt.to_pixels(F.lit(1.0), F.lit(700)), pt.to_pixels(F.lit(1.5), F.lit(700)), pt.to_pixels(F.lit(None).cast("double"), F.lit(700))) == (700.0, 1.5, None)


def test_scalars_on_nulls(spark):
    d = F.lit(None).cast("double")
    arr = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    assert _one(spark, pt.clipped(d), pt.clipped(F.lit(7.0)), pt.distance_3d(arr(1, 2), arr(1, None)), pt.distance_3d(arr(0, 0), arr(3, 4)), pt.distance_3d(arr(1), arr(1, 2))) == (None, 1.0, None, 5.0, None)
    assert _one(spark, pt.element(arr(4, 5), F.lit(1)), pt.element(arr(4, 5), F.lit(2)), pt.is_zero_pair(arr(0, 0)), pt.is_zero_pair(arr(0, 1)), pt.is_green(d, d, d)) == (5.0, None, True, False, False)


def test_masks(spark):
    px = spark.createDataFrame([(1, 2, 0), (1, 4, 5), (1, 6, 7), (2, 3, 0)], "m long, x long, y long")
    got = {r.m: r for r in pt.mask_shapes(px, ["m"]).collect()}
    assert (got[1].area, got[1].x0, got[1].y1, got[1].centroid_x, got[1].foot_x, got[1].foot_y) == (3, 2, 7, 4.0, 5.0, 7.0)
    assert got[2].foot_x == 3.0 and pt.mask_shapes(px.limit(0), ["m"]).count() == 0


def test_keyframes(spark):
    z = pt.zipped_points(F.array(F.lit("a")), F.array(*[F.array(F.lit(float(k)), F.lit(0.0)) for k in range(3)]), F.array(*[F.array(F.lit(1.0), F.lit(2.0))] * 2))
    points, errors = _one(spark, z, pt.point_errors(F.lit("k"), z, 3))
    assert [p.name for p in points] == ["a", "point_02"]
    assert errors == ["k needs at least 3 point correspondences; found 2.", "k:a video_xy is still placeholder [0, 0]."]


def test_homography_is_found_and_needs_four_pairs(spark):
    m = np.array([[1.2, 0.1, 30], [-0.2, 0.9, 12], [0.0003, -0.0001, 1]])
    rng, rows = np.random.default_rng(4), []
    for k, n in ((1, 4), (2, 40), (3, 3)):
        for x, y in rng.uniform(0, 500, (n, 2)):
            u = m @ [x, y, 1]
            rows.append((k, float(x), float(y), float(u[0] / u[2]), float(u[1] / u[2])))
    rows.append((2, None, 1.0, 1.0, 1.0))
    got = {r.k: r for r in homography.fit(spark.createDataFrame(rows, "k long, x double, y double, u double, v double"), ["k"]).collect()}
    assert sorted(got) == [1, 2] and got[2].points == 40
    assert all(np.allclose(np.reshape(r.matrix, (3, 3)), m, rtol=1e-4, atol=1e-6) for r in got.values())


def test_texts(spark):
    t = F.lit
    assert _one(spark, tx.slug(t("  Lacrosse  Player! ")), tx.slug(t("!!")), tx.jersey_number(t(" 07 ")), tx.jersey_number(t("100")), tx.jersey_number(t("7a")), tx.safe_int(t("x"))) == ("lacrosse_player", "prompt", 7, None, None, None)
    assert _one(spark, tx.nonempty(t(" \t")), tx.nonempty(t(None).cast("string")), tx.digit_candidate(t("a07")), tx.digit_candidate(t("123")), tx.human_size(t(1152)), tx.human_size(t(5))) == (False, False, "07", None, "1.12 KiB", "5.00 B")
    assert _one(spark, tx.segment_tag(t(20.0), t(1.5)), tx.frame_of_path(t("a/frame_0012.jpg")), tx.frame_of_path(t("a/b")), tx.path_key(t("a//./b/"), "/r"), tx.portable_path(t("/r/x/y"), "/r/"), tx.portable_path(t(""), "/r")) == ("segment_20s_1p5s", 12, None, "/r/a/b", "x/y", None)
    assert _one(spark, tx.jersey_candidates(t("<ref>7 and 123</ref> Number 07 no. 45<box>9</box>")), tx.jersey_candidates(t(None).cast("string"))) == (["7", "45"], [])


def test_overlaps_and_cells_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 3), Row(*map(float, (x, y, x + w, y + h)))) for i, (x, y, w, h) in enumerate(rng.uniform([-20, -20, 0, 0], [200, 150, 90, 60], (150, 4)))]
    schema = "id long, f long, b struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame([*rows, (900, 0, None)], schema)
    got = {r.id: r.overlap for r in joins.largest_overlap(df, "id", ["f"], "b", 180, 120).collect()}

    def cut(b):
        x0, y0, x1, y1 = (max(0, min(m, f(v))) for v, m, f in zip(b, (179, 119, 179, 119), (np.floor, np.floor, np.ceil, np.ceil), strict=True))
        return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None

    cuts = {i: (f, cut(b)) for i, f, b in rows}
    for i, (f, a) in cuts.items():
        best = 0.0
        for j, (g, b) in cuts.items():
            if a and b and i != j and f == g:
                w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
                if w > 0 and h > 0:
                    best = max(best, w * h / ((a[2] - a[0] + 1) * (a[3] - a[1] + 1)))
        assert abs(got[i] - (best if a else 1.0)) < 1e-9
    assert got[900] == 1.0
    pts = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (120, 2)))] + [(500, 0, None, 1.0)]
    a = spark.createDataFrame(pts, "i long, f long, x double, y double")
    met = joins.near_join(a, a.select(F.col("i").alias("j"), "f", F.col("x").alias("u"), F.col("y").alias("v")), ["f"], ["x", "y"], ["u", "v"], 9.0)
    want = {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if p[1] == q[1] and np.hypot(p[2] - q[2], p[3] - q[3]) <= 9}
    assert sorted((r.i, r.j) for r in met.select("i", "j").collect()) == sorted(want)


def test_nearest_keyframe_in_blocks(spark):
    rng = np.random.default_rng(7)
    keys, frames = sorted({int(k) for k in rng.integers(-9000, 9000, 25)}), [int(f) for f in rng.integers(-12000, 12000, 300)]
    got = joins.nearest_join(spark.createDataFrame([(f,) for f in [*frames, None]], "f long"), spark.createDataFrame([(k,) for k in keys], "k long"), "f", "k", 400).collect()
    assert len(got) == 301
    for r in got:
        if r.f is None:
            assert r.keyframe is None
            continue
        near = min(keys, key=lambda k: (abs(k - r.f), k))
        assert r.frame_distance == abs(near - r.f) and r.keyframe == (near if abs(near - r.f) <= 400 else None)
    none = joins.nearest_join(spark.range(2).selectExpr("id as f"), spark.range(0).selectExpr("id as k"), "f", "k", 5).collect()
    assert [(r.keyframe, r.frame_distance) for r in none] == [(None, None)] * 2


def test_running_totals_in_blocks(spark):
    rng = np.random.default_rng(8)
    at = sorted({int(v) for v in rng.integers(-5_000_000, 5_000_000, 200)})
    rows = [(v, int(n)) for v, n in zip(at, rng.integers(1, 9, len(at)), strict=True)]
    got = {r.at: r.total for r in spatial.running_totals(spark.createDataFrame(rows, "at long, n long"), "at", "n", "total").collect()}
    assert got == {v: int(t) for (v, _), t in zip(rows, np.cumsum([n for _, n in rows]), strict=True)}


def test_sampling_edges(spark):
    assert _one(spark, select.stride(F.lit(25.0), F.lit(10.0)), select.stride(F.lit(5.0), F.lit(30.0)), select.duration(F.lit(10), F.lit(0.0)), *select.clip_bounds(F.lit(-1.0), F.lit(2.0), F.lit(10.0), F.lit(15))) == (2, 1, None, 0, 15)
    assert _one(spark, select.interval_frames(F.lit(1.0), F.lit(0.0), F.lit(10.0), F.lit(9), 3), select.interval_frames(F.lit(-1.0), F.lit(1.0), F.lit(10.0), F.lit(9), 3)) == ([0, 1, 2], [])


def test_density_of_nothing(spark):
    grid = spark.createDataFrame([(0, 0, 0)], "cell_x long, cell_y long, n long")
    assert spatial.normalised(grid).first().level == 0 and spatial.normalised(grid.limit(0)).count() == 0
    hists = spark.createDataFrame([(1, [1.0, -1.0]), (1, [-1.0, 1.0]), (2, [3.0, 4.0]), (2, None)], "k long, h array<double>")
    assert {r.k: r["mean"] for r in spatial.mean_histograms(hists, ["k"], "h").collect()} == {1: None, 2: [0.6, 0.8]}


def test_arrays_and_bounds(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(24.0).reshape(2, 4, 3))
    got = crops.array_points(spark, str(tmp_path)).orderBy("at").collect()
    assert [r["values"] for r in got] == np.arange(24.0).reshape(8, 3).tolist()
    assert crops.parse_bounds(None, 4, 5) == (0.0, 0.0, 4.0, 5.0) and crops.parse_bounds("1, 2,3,4", 9, 9) == (1.0, 2.0, 3.0, 4.0)
    for bad in ("1,2,3", "3,2,1,4"):
        with pytest.raises(ValueError):
            crops.parse_bounds(bad, 9, 9)
    none = spark.createDataFrame([("t", 1, None), ("t", 1, [0.5, 0.5, 2.5, 9.0])], "track_id string, frame long, bbox array<double>")
    assert [r.corners for r in crops.player_crops(none, spark.createDataFrame([(1, 3, 3)], "frame long, width long, height long")).collect()] == [[0, 0, 2, 3]]


def test_shares_of_boxes_that_are_apart(spark):
    """All pairs of a frame, also those that share no area."""
    from trackloom import plans

    got = plans.QUERIES["box_pair_shares"](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_partkey")
    other = lines.withColumnRenamed("l_partkey", "other")
    assert got.count() == lines.join(other, "l_orderkey").where("l_partkey < other").count()
    assert got.where("of_first = 0").count() > 0


def test_polygon_texts_are_read_once(spark):
    """Texts of polygons are parsed in one row of their own, which the points meet."""
    from trackloom import plans

    plan = plans.QUERIES["polygon_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[0]
    assert "from_json" not in top and "split(" not in top and "plain#" in top
