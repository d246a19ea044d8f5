"""Small record shapes: odd paths, manifests, typed values, keyframes."""

import posixpath

import pytest
from pyspark.sql import functions as F

from trackloom.operators import records


def test_plain_paths(spark):
    paths = ["/a/b", "a//b/", "./a/../b", "/..", "/../x", "a/./b/../../..", "", "/a/b/../c/.", "//a"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", records.plain_path(F.col("p"), "/root/run").alias("q")).collect()
    for r in got:
        want = posixpath.normpath(r.p if r.p.startswith("/") else "/root/run/" + r.p)
        assert r.q == want.replace("//", "/")


def test_manifest_regions(spark):
    images = spark.createDataFrame([("a", 3, 2, 1, bytearray(b"abcdef"))], "path string, width int, height int, channels int, pixels binary")
    rows = [("a", "box", "raw", None), ("a", None, "gray", False)]
    held = spark.createDataFrame(rows, "region_path string, source_region_box string, variant_name string, manifest_preprocessed_region boolean")
    got = records.manifest_regions(held, images).orderBy("variant_name").collect()
    assert [(r.variant_name, r.width, bytes(r.pixels), r.source, r.manifest_preprocessed_region) for r in got] == [("gray", 3, b"abcdef", "enhanced_number_region_manifest", False), ("raw", 3, b"abcdef", "enhanced_number_region_manifest", True)]
    lost = held.unionAll(spark.createDataFrame([("b", None, "x", None)], held.schema))
    with pytest.raises(Exception, match="could not read the number region b"):
        records.manifest_regions(lost, images).collect()


def test_number_values(spark):
    texts = ['[1, 2.5, "3", null, true, false, [4], {"a": 5}]', "[]", '{"a": 1}', "not json", None, "7", "[1e3, -0.5, 123456789012345678901234567890]"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", records.number_values(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [[1.0, 2.5, 1.0, 0.0], [], [], [], [], [], [1000.0, -0.5, 123456789012345678901234567890.0]]


def test_points_and_keyframes(spark):
    p = spark.createDataFrame([(1, (0.1, 2.0)), (2, (None, 2.0)), (3, None)], "i int, p struct<x: double, y: double>")
    got = p.select("i", records.point_array(F.col("p")).alias("a")).withColumn("b", records.array_point(F.col("a"))).orderBy("i").collect()
    assert got[0].a == pytest.approx([0.1, 2.0]) and got[0].b.y == 2.0 and [(r.a, r.b) for r in got[1:]] == [(None, None)] * 2
    points = spark.createDataFrame([("b", [1.0, 2.0], [3.0, 4.0]), ("a", [5.0, 6.0], [7.0, 8.0])], "name string, video_xy array<double>, field_xy array<double>")
    frames = spark.createDataFrame([(9, "/f/9")], "frame_index long, path string")
    rows = records.seed_keyframes(points, frames, 4, 9, "none").orderBy("frame_index").collect()
    assert [(r.name, r.frame_path, [x.name for x in r.points]) for r in rows] == [("frame_004", "none", ["a", "b"]), ("frame_009", "/f/9", [])]
    assert records.seed_keyframes(points, frames.limit(0), 4, 9, "none").count() == 1
    shown = records.keyframe_rows(records.seed_keyframes(points, frames, 4, 9, "none").withColumn("fitted", F.lit(1)))
    assert "fitted" not in shown.columns and not any(r.interpolate for r in shown.collect())


def test_audits_without_crops(spark):
    clean = spark.createDataFrame([("x/a.png", 1, 0.9, 0), ("/r/x/./a.png", 2, None, 1)], "crop_path string, crop int, crop_quality_score double, ordinal int")
    names = "crop_path string, ocr_readiness_score double, auto_quality_score double, quality_score double, heuristic_likely_view string, likely_view string, ocr_candidate boolean, audit_status string, rejection_reason string, number_region_box string, number_region_guess string"
    audits = spark.createDataFrame([("/r/x/a.png", None, None, None, None, "side", None, "ok", None, None, None), ("/r/gone.png", *[None] * 10)], names)
    held, lost = records.audited_crops(clean, audits, "/r")
    r = held.collect()[0]
    assert (r.crop, r.ocr_readiness_score, r.heuristic_likely_view, r.audit_ocr_candidate, r.number_region_guess) == (2, 0.0, "side", False, "unknown")
    assert [x.crop_path for x in lost.collect()] == ["/r/gone.png"]
    none, _ = records.audited_crops(clean, audits, "/r", spark.createDataFrame([("/r/other",)], "path string"))
    assert none.isEmpty()
