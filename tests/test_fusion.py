"""Masks on grids of points against plain loops."""

import math
import random

import numpy as np
import pytest
from test_rasters import _frame

from trackloom import rasters
from trackloom.operators.components import Scratch
from trackloom.rasters import fusion


@pytest.mark.parametrize("grid", [(3, 2), (11, 9), (40, 33)])
def test_fused_masks(spark, grid):
    r, (gw, gh) = random.Random(4), grid
    masks = {k: np.random.default_rng(k).integers(0, 2, (r.randrange(1, 25), r.randrange(1, 25), 1)).astype(np.uint8) for k in range(8)}
    masks[6][:] = 0
    kept = [(k, None if k == 7 else k % 4, k * 10) for k in masks] + [(99, 1, 5)]
    odd = [1.0, 1.0, 1.0, float("nan"), float("inf"), None]
    points = [(f, x, y, r.uniform(-5, 5), r.uniform(-5, 5), r.uniform(-5, 5) * r.choice([1.0, 1.0, 1.0, float("nan")]), None if (c := r.choice(odd)) is None else r.random() * c) for f in (0, 1, 2) for x in range(gw) for y in range(gh)]
    got = {
        m.mask_id: m
        for m in fusion.fused_masks(
            spark.createDataFrame(kept, "image long, frame_index int, mask_id int"), rasters.tiles(_frame(spark, masks), 6),
            spark.createDataFrame(points, "frame_index int, gx int, gy int, x double, y double, z double, confidence double"), gw, gh, 0.3, 6).collect()
    }
    assert len(got) == len(kept)
    for k, frame, mask in kept:
        m = got[mask]
        if frame not in (0, 1, 2):
            assert m.skip_reason == "no_matching_vggt_frame" and m.point_count is None
            continue
        own = []
        for f, x, y, *v in points:
            if f == frame and k in masks and all(c is not None and math.isfinite(c) for c in v) and v[3] >= 0.3:
                h, w = masks[k].shape[:2]
                if masks[k][int((y + 0.5) * h / gh), int((x + 0.5) * w / gw), 0]:
                    own.append(v)
        assert m.skip_reason is None and m.point_count == len(own)
        if own:
            a = np.array(own)
            assert np.allclose(m.centroid, a[:, :3].mean(axis=0)) and m.low == a[:, :3].min(axis=0).tolist() and m.high == a[:, :3].max(axis=0).tolist()
            assert np.allclose(m.spread, a[:, :3].max(axis=0) - a[:, :3].min(axis=0)) and math.isclose(m.confidence_mean, a[:, 3].mean()) and (m.confidence_min, m.confidence_max) == (a[:, 3].min(), a[:, 3].max())
        else:
            assert m.centroid is None


def test_preview(spark):
    r = random.Random(6)
    points = [(f, x, y, r.random(), r.random(), r.random(), r.choice([0.1, 0.5, 0.9, float("nan")])) for f in range(4) for x in range(9) for y in range(7)] + [(9, 0, 0, 1.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(points, "frame_index int, gx int, gy int, x double, y double, z double, confidence double").repartition(5)
    valid = sorted((p for p in points if p[6] > 0.5), key=lambda p: (p[0], p[2], p[1]))
    with Scratch(spark) as scratch:
        for most in (1, 7, 50, 10_000):
            shown, whole, frames = fusion.cloud_preview(scratch, df, 0.5, most)
            want = valid if len(valid) <= most else [valid[k] for k in np.linspace(0, len(valid) - 1, most).round().astype(int)]
            assert sorted(map(tuple, shown.collect())) == sorted(want)
            one = whole.collect()[0]
            assert (one.total_valid_points, one.saved_preview_points) == (len(valid), len(want)) and one.low == [min(p[k] for p in valid) for k in (3, 4, 5)]
            assert dict(map(tuple, frames.collect())) == {f: sum(p[0] == f for p in valid) for f in (0, 1, 2, 3, 9)}
        _, none, _ = fusion.cloud_preview(scratch, df.limit(0), 0.5, 5)
        assert tuple(none.collect()[0]) == (0, None, None, 0)
