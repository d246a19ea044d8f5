"""Arrays by ranges of rows, previews, video headers; one pass with several sinks."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import stages
from trackloom.operators.components import Scratch
from trackloom.sources import binary


def test_array_rows_spread_over_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    held = {"a": r.normal(size=(3, 7, 5)).astype("<f4"), "b": r.integers(-9, 9, 11), "c": np.zeros((0, 4)), "d": r.normal(size=(40, 2)).astype(">f8")}
    for k, v in held.items():
        np.save(tmp_path / f"{k}.npy", v)
    got = binary.array_rows(spark, str(tmp_path), rows=4)
    assert got.rdd.getNumPartitions() == 6 + 3 + 10
    rows = {}
    for x in got.collect():
        rows.setdefault(x.path[-5], {})[x["at"]] = x["values"]
    for k, v in held.items():
        flat = v.reshape(-1, v.shape[-1] if v.ndim > 1 else 1).astype(float)
        assert [rows.get(k, {})[i] for i in range(len(flat))] == flat.tolist() and len(rows.get(k, {})) == len(flat)
    assert binary.array_rows(spark, f"file://{tmp_path}/b.npy").count() == 11
    np.save(tmp_path / "e.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="C-ordered"):
        binary.array_rows(spark, str(tmp_path)).count()


def test_cloud_prefers_its_preview(spark, tmp_path):
    r = np.random.default_rng(2)
    points, conf = r.normal(size=(1, 4, 3, 5, 3)).astype(np.float32), r.random((1, 4, 3, 5)).astype(np.float32)
    points[0, 1, 2, 3, 0], conf[0, 0, 0, 0] = np.nan, np.inf
    np.save(tmp_path / "world_points.npy", points)
    with pytest.raises(FileNotFoundError):
        binary.cloud(spark, str(tmp_path))
    np.save(tmp_path / "world_points_conf.npy", conf)

    def want(p, c, f, most):
        valid = np.flatnonzero(np.isfinite(p).all(axis=1) & np.isfinite(c) & (c >= 0.4))
        some = valid if len(valid) <= most else valid[np.linspace(0, len(valid) - 1, most).round().astype(int)]
        return len(valid), sorted((int(f[k]), *map(float, p[k]), float(c[k])) for k in some)

    with Scratch(spark) as scratch:
        got = binary.load_points(scratch, str(tmp_path), 0.4, 13, rows=7)
        n, rows = want(points.reshape(-1, 3), conf.ravel(), np.repeat(np.arange(4), 15), 13)
        assert (got["source"], got["valid_count_in_source"], got["source_count"]) == ("world_points.npy", n, 60)
        assert sorted(map(tuple, got["points"].drop("at").collect())) == rows
    np.savez_compressed(tmp_path / "point_cloud_preview.npz", points=points[0, 0].reshape(-1, 3), confidence=conf[0, 0].ravel(), frame_index=np.full(15, 3, np.int16))
    with Scratch(spark) as scratch:
        got = binary.load_points(scratch, str(tmp_path), 0.4, 100)
        n, rows = want(points[0, 0].reshape(-1, 3), conf[0, 0].ravel(), np.full(15, 3), 100)
        assert (got["source"], got["valid_count_in_source"], got["source_count"]) == ("point_cloud_preview.npz", n, 15)
        assert sorted(map(tuple, got["points"].drop("at").collect())) == rows
    (tmp_path / "point_cloud_preview.npz").unlink()
    np.save(tmp_path / "world_points_conf.npy", conf[0])
    with pytest.raises(ValueError, match="expected"):
        binary.cloud(spark, str(tmp_path))


def _box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def _mp4(frames, scale, length, width, height, long=False, before=b""):
    mdhd = struct.pack(">I", 1 << 24) + struct.pack(">QQIQ", 0, 0, scale, length) + b"\0" * 4 if long else struct.pack(">I", 0) + struct.pack(">IIII", 0, 0, scale, length) + b"\0" * 4
    tkhd = b"\0" * 76 + struct.pack(">II", width << 16, height << 16)
    track = lambda kind: _box(b"trak", _box(b"tkhd", tkhd), _box(b"mdia", _box(b"mdhd", mdhd), _box(b"hdlr", b"\0" * 8, kind, b"\0" * 12), _box(b"minf", _box(b"stbl", _box(b"stsz", struct.pack(">III", 0, 0, frames))))))
    return _box(b"ftyp", b"isom") + before + _box(b"moov", _box(b"mvhd", b"\0" * 100), track(b"soun"), track(b"vide"))


def _chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _avi(frames, scale, rate, width, height, stream=True):
    avih = struct.pack("<14I", 40_000, 0, 0, 0, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vids" + b"XVID" + struct.pack("<3I", 0, 0, 0) + struct.pack("<4I", scale, rate, 0, frames) + b"\0" * 20
    lists = _chunk(b"avih", avih) + (_chunk(b"LIST", b"strl" + _chunk(b"strh", strh)) if stream else b"")
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + lists) + _chunk(b"JUNK", b"abc") + _chunk(b"LIST", b"movi" + b"\xff" * 64)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_video_headers(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(_mp4(75, 30_000, 75_075, 1920, 1080))
    (tmp_path / "b.mov").write_bytes(_mp4(0, 600, 0, 64, 48, long=True, before=struct.pack(">I4sQ", 1, b"mdat", 16 + 9) + b"\xff" * 9))
    (tmp_path / "c.avi").write_bytes(_avi(50, 1001, 30_000, 640, 480))
    (tmp_path / "d.avi").write_bytes(_avi(50, 0, 0, 640, 480, stream=False))
    got = {r.path[-5:]: (r.container, round(r.fps, 6), r.frame_count, r.width, r.height, None if r.duration_sec is None else round(r.duration_sec, 6)) for r in binary.video_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.mp4": ("iso", 29.97003, 75, 1920, 1080, 2.5025), "b.mov": ("iso", 0.0, 0, 64, 48, None), "c.avi": ("avi", 29.97003, 50, 640, 480, 1.668333), "d.avi": ("avi", 25.0, 50, 640, 480, 2.0)}
    assert binary.video_headers(spark, str(tmp_path), "*.mkv").isEmpty()
    (tmp_path / "e.txt").write_bytes(b"not a video at all")
    with pytest.raises(Exception, match="could not read the video's header"):
        binary.video_headers(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="missing"):
        binary.video_headers(spark, str(tmp_path / "missing")).collect()


def test_one_pass_several_sinks(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).select(F.col("id").alias("track"), (F.col("id") % 5).alias("kind")).repartition(4).mapInArrow(count, "track long, kind long")
    sinks = {"tracks": (lambda d: d.where("kind > 0"), str(tmp_path / "tracks")), "masks": (lambda d: d.select("kind").distinct(), str(tmp_path / "masks"))}
    counts = {"rows": F.count(F.lit(1)), "kinds": F.max("kind") + 1, "kept": F.count_if(F.col("kind") > 0)}
    told = stages.one_pass(rows, sinks, counts, {"stage": "segmentation"}, str(tmp_path / "manifest.json"))
    assert seen.value == 100  # the rows were made once
    assert told == {"stage": "segmentation", "status": "complete", "counts": {"rows": 100, "kinds": 5, "kept": 80}, "outputs": {"tracks": str(tmp_path / "tracks"), "masks": str(tmp_path / "masks")}}
    assert json.loads((tmp_path / "manifest.json").read_text()) == told
    assert spark.read.json(str(tmp_path / "tracks")).count() == 80 and spark.read.json(str(tmp_path / "masks")).count() == 5
    none = stages.one_pass(rows.limit(0), sinks, counts, {}, str(tmp_path / "none.json"))
    assert none["counts"] == {"rows": 0, "kinds": None, "kept": 0}


def test_run_with_counts(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    steps = [
        ("frames", lambda d: d["video"].mapInArrow(count, "id long"), {"sampled_frames": F.count(F.lit(1))}),
        ("tracks", lambda d: d["frames"].where("id % 2 = 0"), {"candidate_tracks": F.count(F.lit(1)), "largest": F.max("id")}),
        ("active", lambda d: d["tracks"].where("id > 5"), {"active_tracks": F.count(F.lit(1))}),
    ]
    out, summary = stages.run_with_counts(spark, {"video": spark.range(0, 20, 1, 3)}, steps, str(tmp_path / "run"))
    assert seen.value == 20
    assert summary["counts"] == {"sampled_frames": 20, "candidate_tracks": 10, "largest": 18, "active_tracks": 7}
    assert sorted(r.id for r in out["active"].collect()) == [6, 8, 10, 12, 14, 16, 18]
    assert json.loads((tmp_path / "run" / "run_summary.json").read_text())["counts"]["active_tracks"] == 7
    assert list(summary["stage_outputs"]) == ["frames", "tracks", "active"]
