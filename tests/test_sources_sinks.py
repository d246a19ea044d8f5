import json

import pytest
from pyspark.sql import functions as F

from trackloom import sinks, sources, streaming
from trackloom.operators import filters, select, stages


def test_documents_and_their_faults(spark, tmp_path):
    feet = {"schema": "v", "frames": [{"frame": 1, "players": [{"object_id": 4, "floor_xy_ft": [100.0, 42.5]}, {"id": 9, "floor_xy_ft": [1.0]}, {"floor_xy_ft": [200.0, 85.0]}]}, {"frame_index": 2, "timestamp": 0.5, "players": [{"track_id": 5, "floor_xy_ft": [201.0, 0.0]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(feet))
    (tmp_path / "b.json").write_text('{"schema": ')
    docs = sources.json_documents(spark, f"{tmp_path}/*.json", sources.FEET_FRAMES)
    assert [r.schema for r in docs.collect() if r._corrupt_record is not None] == [None]
    got = sources.adapted_feet(docs.where("schema is not null")).orderBy("frame_index", "track_id").collect()
    assert [(r.frame_index, r.track_id, round(r.x, 6), round(r.y, 6), r.in_feet, r.in_bounds) for r in got] == [(1, 2, 1600.0, 700.0, True, True), (1, 4, 800.0, 350.0, True, True), (2, 5, 1608.0, 0.0, False, False)]
    raw = spark.createDataFrame([("p", None), ("q", "["), ("r", "[1]"), ("s", '{"frames": [{"players": []}], "predictions": [{}, 3]}'), ("t", '{"schema": "x"}')], "path string, raw string")
    state = {r.path: (r.error, r.kind, r.records) for r in sources.read_state(raw, "raw").collect()}
    assert state == {"p": ("file_not_found", None, None), "q": ("invalid_json", None, None), "r": ("top_level_json_is_not_an_object", None, None), "s": (None, "unknown_frames_players_floor_xy", 1), "t": (None, "x", 0)}
    assert sources.valid_documents(raw.where("path in ('s', 't')"), "raw", "path").count() == 2
    for path, fault in (("p", "file_not_found"), ("q", "invalid_json"), ("r", "top_level_json_is_not_an_object")):
        with pytest.raises(Exception, match=f"{path}: {fault}"):
            sources.valid_documents(raw.where(F.col("path").isin(path, "t")), "raw", "path").collect()


def test_rosters(spark, tmp_path):
    doc = {"schema": "r", "team": {"name": "A", "abbreviation": " ab "}, "players": [{"name": " X ", "number": 7, "position": "D"}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert [tuple(r)[:3] for r in sources.roster_players(sources.json_documents(spark, str(tmp_path / "r.json"), sources.ROSTER)).collect()] == [("AB", "X", 7)]


def test_files_and_packages(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "frame_0007.jpg").write_bytes(b"abc")
    (tmp_path / "x" / "frame_0008.jpg").write_bytes(b"y")
    assert [(r.name, r.bytes, r.frame) for r in sources.files(spark, str(tmp_path), "*.jpg").collect()] == [("frame_0007.jpg", 3, 7)]
    deep = sources.files(spark, str(tmp_path), "*.jpg", deep=True)
    assert sources.unique_names(deep).count() == 2
    (tmp_path / "x" / "frame_0007.jpg").write_bytes(b"z")
    with pytest.raises(Exception, match="duplicate file name"):
        sources.unique_names(sources.files(spark, str(tmp_path), "*.jpg", deep=True)).collect()
    found = sources.file_records(spark, str(tmp_path))
    assert found.count() == 3 and not any(r.oversize for r in found.collect())
    (tmp_path / "x" / "frame_0009.jpg").write_bytes(b"")
    (tmp_path / "_hidden.jpg").write_bytes(b"")
    empty = [r for r in sources.files(spark, str(tmp_path), "*.jpg", deep=True).collect() if not r.bytes]
    assert [(r.name, r.frame, r.path.startswith("file:")) for r in empty] == [("frame_0009.jpg", 9, True)]
    assert [r.sha256[:8] for r in sources.file_records(spark, str(tmp_path)).collect() if not r.bytes] == ["e3b0c442"]
    expected = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "path string, required boolean")
    there = spark.createDataFrame([("a", 5), ("c", 100 << 20)], "path string, bytes long")
    inv = sinks.package_inventory(expected, there)
    assert {r.path: r.state for r in inv.collect()} == {"a": "present", "b": "absent", "c": "oversize"}
    assert tuple(sinks.checked_package(inv).first()) == (2, 5 + (100 << 20), 1)
    with pytest.raises(Exception, match="required files are missing"):
        sinks.checked_package(sinks.package_inventory(expected, there.limit(0))).collect()


def test_masks_of_frames_with_the_last_fusion(spark):
    meta = spark.createDataFrame([(1, [(5, None, None, None, 0.5), (6, None, None, None, None)]), (2, [])], "frame_index long, kept_masks array<struct<mask_id: long, bbox: string, centroid: string, bottom_center_point: string, confidence_score: double>>")
    fusion = spark.createDataFrame([(1, 5, [1.0], 3, 0), (1, 5, [2.0], 4, 1), (None, 6, [9.0], 9, 2)], "frame_index long, mask_id long, centroid_3d array<double>, point_count long, ordinal long")
    got = sources.kept_masks(meta, fusion).orderBy("mask_id").collect()
    assert [(r.mask_id, r.centroid_3d, r.point_count) for r in got] == [(5, [2.0], 4), (6, None, 0)]


def test_writers(spark, tmp_path):
    sinks.write_document(spark, {"b": 1, "a": [2]}, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'
    points = spark.createDataFrame([(k, float(k), 0.5, -1.0, k, 0, 255) for k in range(9)], "i long, x double, y double, z double, red int, green int, blue int").repartition(3)
    assert sinks.write_ply(points, str(tmp_path / "c"), ["i"], 3) == 3
    lines = [line for p in sorted((tmp_path / "c").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "ply" and lines[2] == "element vertex 3" and lines[9] == "end_header" and lines[10:] == ["0.000000 0.500000 -1.000000 0 0 255", "4.000000 0.500000 -1.000000 4 0 255", "8.000000 0.500000 -1.000000 8 0 255"]
    audits = spark.createDataFrame([(2, 1, "p", "torso", "back", 0.5, True), (1, 9, "q", "full", "side", 1.0, None)], "track_id long, frame_index long, crop_path string, crop_type string, likely_view string, auto_quality_score double, ocr_candidate boolean")
    sinks.write_csv(sinks.review_table(audits).coalesce(1), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert text[0] == ",".join(sinks.REVIEW_COLUMNS) and text[1].startswith("1,9,q,full,side,1.000000,false,") and text[2].startswith("2,1,p,torso,back,0.500000,true")
    sinks.write_rows(points, str(tmp_path / "j"))
    sinks.write_arrays(points.select(F.array("x", "y").alias("a")), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "j")).count() == 9 and spark.read.parquet(str(tmp_path / "n")).count() == 9
    assert sinks.replaced_section("a\n# H\nold\n# N\nz", "# H", "# N", "# H\nnew") == "a\n# H\nnew\n\n# N\nz" and sinks.replaced_section("a\n", "# H", "# N", "# H\n") == "a\n\n# H\n"
    assert sinks.replaced_section("# N\na\n# H\nold\n# N\nz", "# H", "# N", "# H\nnew") == "# N\na\n# H\nold\n# N\nz\n\n# H\nnew\n"


def test_stage_rows(spark):
    s = spark.createDataFrame([(1, "complete", True, None), (2, None, False, "file_not_found"), (3, "blocked", True, None)], "id long, status string, found boolean, error string")
    records = stages.stage_records(s)
    assert [r.state for r in records.orderBy("id").collect()] == ["complete", "missing", "blocked"]
    full = records.where("id <> 2")
    got = [stages.checkpoint_state(*c).first().state for c in ((records, True, 1, True), (full, False, 0, True), (full, True, 0, False), (full, True, 2, False), (full, True, 2, True))]
    assert got == ["incomplete_missing_stage_summaries", "checkpoint_complete_ocr_unavailable", "checkpoint_complete_no_accepted_jersey_numbers", "checkpoint_complete_identity_pending", "complete"]
    names = spark.createDataFrame([("x.png", "/far/x.png")], "name string, path string")
    rows = spark.createDataFrame([(1, "/here/x.png"), (2, "/here/y.png"), (3, None)], "id long, p string")
    assert [r.p for r in stages.mapped_paths(rows, "p", names, strict=False).orderBy("id").collect()] == ["/far/x.png", None, None]
    assert stages.mapped_paths(rows.limit(1), "p", names).first().p == "/far/x.png"
    with pytest.raises(Exception, match="no such file"):
        stages.mapped_paths(rows, "p", names).collect()
    stages.check_inference(False, "missing", False, False)
    for status, local in (("missing", True), ("ready_for_guarded_import", False)):
        with pytest.raises(RuntimeError):
            stages.check_inference(True, status, local, False)
    a, b = (spark.createDataFrame([(x,) for x in v], "id long") for v in ([1, 2, 2, None], [2, None]))
    assert tuple(stages.id_checks(a, b, "id").first()) == (4, 2, 1, 0, 1, 0, False, True)
    assert stages.required(a.where("id = 1"), "id = 1", "bad").count() == 1
    with pytest.raises(Exception, match="bad"):
        stages.required(a, "id = 1", "bad").collect()
    frames = spark.createDataFrame([(k, 100, 200) for k in range(9)], "frame_index long, width int, height int")
    assert [(r.frame_index, r.bbox_xyxy, r.mask_area_px) for r in stages.placeholder_track(frames).collect()] == [(k, [42, 70, 52, 164], 940) for k in range(6)]
    assert [r.n for r in spark.createDataFrame([("attack_zone", 7), (" ", 1234), ("x", 1)], "name string, f int").select(stages.keyframe_name(F.col("name"), F.col("f")).alias("n")).collect()] == ["frame_007", "frame_1234", "x"]
    known = {"a": {"inherits": "b", "x": {"p": 1}}, "b": {"x": {"p": 0, "q": 2}, "y": 3}, "c": {"inherits": "c"}}
    assert stages.load_config(known.__getitem__, "a") == {"x": {"p": 1, "q": 2}, "y": 3}
    with pytest.raises(ValueError):
        stages.load_config(known.__getitem__, "c")
    assert stages.run_stages({"n": 1}, [("m", lambda d: d["n"] + 1), ("k", lambda d: d["m"] * 5)]) == {"n": 1, "m": 2, "k": 10}
    assert stages.not_run(a.limit(1)).first().status == "not_run"


def test_filters_on_nulls_and_ties(spark):
    o = spark.createDataFrame([(1, 0.5, 0.0, 0.0)] * 3 + [(2, None, 0.5, 0.5)], "track_id long, overlap double, referee double, bench double")
    got = {r.track_id: (r.reasons, r.kept) for r in select.active_tracks(o).collect()}
    assert got == {1: ([], True), 2: (["track_too_short", "insufficient_playing_surface_overlap", "referee_rejection", "bench_crowd_suppression"], False)}
    c = lambda v, t="double": F.lit(v).cast(t)
    why = filters.mask_reasons(F.lit("combined"), c(34, "int"), c(None), c(None), c(None, "boolean"), F.lit(False), c(None, "boolean"), 10, 20, 30)
    assert spark.range(1).select(why).first()[0] == ["empty_mask", "too_small", "bottom_point_outside_field_y_band"]
    both = filters.mask_reasons(F.lit("combined"), c(35, "int"), c(25), c(12), c(None, "boolean"), F.lit(False), F.lit(True), 10, 20, 30)
    assert spark.range(1).select(both).first()[0] == ["bottom_point_above_field_cutoff", "bottom_point_outside_field_y_band"]
    audits = spark.createDataFrame([(1, f, f % 2 == 0, f"p{f}", "ocr_ready", "front", 0.8) for f in range(5)] + [(2, 1, True, "q", "borderline", "back", None)], "track_id long, frame long, torso boolean, crop_path string, audit_status string, likely_view string, score double")
    t = {r.track_id: r for r in filters.audited_tracks(audits, 3).collect()}
    assert t[1].best_front_paths == ["p0", "p2", "p4"] and t[1].readiness == "ready" and t[2].readiness == "not_ready" and t[2].best_overall_paths == []
    assert filters.audited_tracks(audits.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, 0, "s", 0.5, False), (1, 0, "t", 0.5, True), (1, 1, "s", 0.4, False), (1, 1, "s", 0.1, True)], "track_id long, frame long, source string, readiness double, torso boolean")
    assert sorted((r.frame, r.source, r["rank"]) for r in select.best_sources(rows, 2).collect()) == [(0, "t", 1), (1, "s", 2), (1, "s", 2)]


def test_windows_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select event_id, timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(0, 0, cast(event_id as int) * 20) as ts, if(event_id % 2 = 0, 'a', 'b') as event_type from (select id as event_id from range(12))").write.parquet(str(src))
    table = spark.read.parquet(str(src))
    want = sorted(map(tuple, streaming.windowed_counts(table).collect()))
    live = streaming.windowed_counts(spark.readStream.schema(table.schema).parquet(str(src)))
    q = live.writeStream.format("memory").queryName("live_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("live_counts").collect())) == want and want
