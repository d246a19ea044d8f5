"""Rasters against plain loops, with tiles smaller than the rasters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import rasters
from trackloom.operators.components import Scratch, components
from trackloom.rasters import colour, measures, regions


def _frame(spark, images):
    rows = [(k, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes())) for k, a in images.items()]
    return spark.createDataFrame(rows, rasters.RASTER)


def _noise(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def _drawing(seed, h, w, things=9):
    """Filled and hollow boxes and discs on a ground, some within others."""
    r = random.Random(seed)
    a = np.full((h, w, 3), r.randrange(60), np.uint8)
    yy, xx = np.mgrid[:h, :w]
    for _ in range(things):
        cy, cx, s = r.randrange(h), r.randrange(w), r.randrange(2, max(3, min(h, w) // 3))
        tone = [r.randrange(256) for _ in range(3)]
        far = np.maximum(abs(yy - cy), abs(xx - cx)) if r.random() < 0.5 else np.hypot(yy - cy, xx - cx)
        a[(far <= s) & (far > s - r.choice([1, 2, 4, 99]))] = tone
    return a


@pytest.fixture(scope="module")
def images():
    out = {k: f(k, h, w) for k, (f, h, w) in enumerate([(_noise, 1, 1), (_noise, 1, 9), (_noise, 9, 1), (_noise, 2, 2), (_noise, 13, 17), (_drawing, 30, 41), (_drawing, 24, 24), (_drawing, 33, 20), (_drawing, 40, 40)])}
    far = np.hypot(*(np.mgrid[:50, :50] - 24.7))  # discs within discs, with soft borders so that their edges close
    ring = np.repeat(np.clip(128 + 90 * np.sin(far * 0.6), 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    return {**out, 20: ring, 21: np.zeros((7, 7, 3), np.uint8)}


def test_tiles_and_halo(spark, images):
    tiles = rasters.tiles(_frame(spark, images), 5)
    assert tiles.count() == sum(math.ceil(a.shape[0] / 5) * math.ceil(a.shape[1] / 5) for a in images.values())
    for border, mode in (("edge", "edge"), ("mirror", "reflect")):
        whole = lambda p, t: [(t.image, t.ty, t.tx, p.tobytes())]
        got = {(r.image, r.ty, r.tx): bytes(r.pixels) for r in rasters.stencil(tiles, whole, "image long, ty int, tx int, pixels binary", 2, border, 5).collect()}
        for k, a in images.items():
            if mode == "reflect" and min(a.shape[:2]) < 3:
                continue
            wide = np.pad(a, ((2, 2), (2, 2), (0, 0)), mode)
            for ty in range(math.ceil(a.shape[0] / 5)):
                for tx in range(math.ceil(a.shape[1] / 5)):
                    h, w = min(5, a.shape[0] - ty * 5), min(5, a.shape[1] - tx * 5)
                    assert got[k, ty, tx] == wide[ty * 5 : ty * 5 + h + 4, tx * 5 : tx * 5 + w + 4].tobytes()


def test_rasters_of_bytes_and_odd_rasters(spark):
    rows = spark.createDataFrame([(1, b"abcdefg"), (2, b""), (3, None), (4, b"x" * 12)], "i long, b binary")
    got = {r.image: (r.height, bytes(r.pixels)) for r in rasters.raster_of_bytes(rows, "i", F.col("b"), 2).collect()}
    assert got == {1: (2, b"abcdefg" + b"\0" * 5), 2: (0, b""), 3: (0, b""), 4: (2, b"x" * 12)}
    odd = spark.createDataFrame([(None, 1, 1, 3, bytearray(b"abc")), (1, 0, 0, 3, bytearray()), (2, 1, 1, 3, None)], rasters.RASTER)
    assert rasters.tiles(odd).isEmpty()
    assert measures.image_stats(rasters.tiles(odd)).isEmpty() and measures.crop_stats(rasters.tiles(odd)).isEmpty()


def test_pixmaps(spark, tmp_path):
    a, g = _noise(1, 3, 4), _noise(2, 2, 5, 1)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n4 3\n255\n" + a.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 5 2 255 " + g.tobytes())
    got = {r.path[-5:]: (r.width, r.height, r.channels, bytes(r.pixels)) for r in rasters.pixmaps(spark, str(tmp_path)).collect()}
    assert got == {"a.ppm": (4, 3, 3, a.tobytes()), "b.pgm": (5, 2, 1, g.tobytes())}
    (tmp_path / "c.ppm").write_bytes(b"P6 4 4 255 abc")
    with pytest.raises(Exception, match="cut short"):
        rasters.pixmaps(spark, str(tmp_path)).collect()


def test_hsv_of_known_colours():
    known = {(255, 0, 0): (0, 255, 255), (0, 255, 0): (60, 255, 255), (0, 0, 255): (120, 255, 255), (255, 255, 0): (30, 255, 255), (255, 0, 255): (150, 255, 255), (0, 0, 0): (0, 0, 0), (128, 128, 128): (0, 0, 128), (200, 100, 50): (10, 191, 200)}
    h, s, v = colour.hsv(np.array([*known], np.uint8))
    assert list(zip(h.tolist(), s.tolist(), v.tolist(), strict=True)) == [*known.values()]
    every = colour.hsv(np.random.default_rng(0).integers(0, 256, (100_000, 3)).astype(np.uint8))
    assert every[0].min() >= 0 and every[0].max() < 180 and every[1].max() <= 255


def test_measures_of_whole_rasters(spark, images):
    tiles = rasters.tiles(_frame(spark, images), 5)
    stats = {r.image: r for r in measures.image_stats(tiles, 5).collect()}
    sharp = {r.image: r.sharpness for r in measures.sharpness(tiles, 5).collect()}
    crops = {r.image: r for r in measures.crop_stats(tiles, 5).collect()}
    for k, a in images.items():
        flat = a.reshape(-1, 3).astype(float)
        assert np.allclose([stats[k][f"mean_{c}"] for c in "rgb"], flat.mean(axis=0)) and np.allclose([stats[k][f"std_{c}"] for c in "rgb"], flat.std(axis=0), atol=1e-6)
        grey = colour.grey_16(a).astype(float)
        if min(a.shape[:2]) == 1:
            assert sharp[k] is None
        else:
            assert math.isclose(sharp[k], np.diff(grey, axis=1).var() + np.diff(grey, axis=0).var(), abs_tol=1e-6)
        _, s, v = colour.hsv(a)
        g = colour.grey_14(a)
        at = lambda y, x, a=a, g=g: g[min(abs(y), 2 * (a.shape[0] - 1) - y) if a.shape[0] > 1 else 0][min(abs(x), 2 * (a.shape[1] - 1) - x) if a.shape[1] > 1 else 0]
        edge = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * g[y, x] for y in range(a.shape[0]) for x in range(a.shape[1])]
        c = crops[k]
        want = (s.mean(), np.median(s), (s < 45).mean(), (s > 95).mean(), (v < 70).mean(), ((v > 155) & (s < 70)).mean(), (s < 35).mean(), g.std(), np.var(edge))
        assert np.allclose(want, (c.mean_saturation, c.median_saturation, c.low_saturation_fraction, c.high_saturation_fraction, c.dark_fraction, c.bright_gray_fraction, c.gray_fraction, c.grayscale_std, c.sharpness), atol=1e-6)
        stripe = min(1.0, 0.4 * want[2] + 0.3 * min(1, want[4] / 0.22) + 0.3 * min(1, want[5] / 0.26)) * (0.65 if want[7] < 38 else 1)
        assert math.isclose(c.stripe_score, stripe, abs_tol=1e-9)


def test_patches_and_histograms(spark, images):
    r = random.Random(8)
    tiles = rasters.tiles(_frame(spark, images), 5)
    points = [(k, n, r.choice([None, r.uniform(-12, 50), 2.5, 3.5]), r.uniform(-12, 50)) for k in [*images, 77] for n in range(6)]
    got = {(x.image, x.point): x for x in measures.patch_colours(spark.createDataFrame(points, "image long, point long, x double, y double"), tiles, size=5).collect()}
    assert len(got) == len(points)
    for k, n, x, y in points:
        g = got[k, n]
        x0, y0, x1, y1 = (0, 0, 0, 0) if x is None or k not in images else (max(0, round(x) - 4), max(0, round(y)), min(images[k].shape[1], round(x) + 5), min(images[k].shape[0], round(y) + 9))
        if x0 >= x1 or y0 >= y1:
            assert not g.sampled and not g.is_green and g.r is None
        else:
            mean = images[k][y0:y1, x0:x1].reshape(-1, 3).mean(axis=0)
            assert (g.x0, g.y0, g.x1, g.y1) == (x0, y0, x1, y1) and np.allclose((g.r, g.g, g.b), mean)
            assert g.is_green == bool(mean[1] >= mean[0] * 0.82 and mean[1] >= mean[2] * 0.68 and mean[1] >= 35)
    masks = {k: (a[..., :1] > 120).astype(np.uint8) for k, a in images.items() if k % 3}
    boxes = [(k, n, (r.uniform(-5, 30), r.uniform(-5, 30), r.uniform(5, 60), r.uniform(5, 60)) if n else None) for k in [*images, 77] for n in range(5)]
    frame = spark.createDataFrame(boxes, "image long, detection long, box struct<x0: double, y0: double, x1: double, y1: double>")
    found = {(x.image, x.detection): x for x in measures.with_appearance(frame, tiles, rasters.tiles(_frame(spark, masks), 5), 5).collect()}
    for k, n, box in boxes:
        got, want = found[k, n], None
        if box is not None and k in images:
            h, w = images[k].shape[:2]
            x0, y0, x1, y1 = max(0, int(box[0])), max(0, int(box[1])), min(w - 1, int(box[2])), min(h - 1, int(box[3]))
            if x1 > x0 and y1 > y0:
                hue, sat, _ = colour.hsv(images[k][y0 : y1 + 1, x0 : x1 + 1])
                inside = masks[k][y0 : y1 + 1, x0 : x1 + 1, 0] > 0 if k in masks else np.zeros(hue.shape, bool)
                inside = inside if inside.any() else np.ones(hue.shape, bool)
                bins = np.bincount((hue // 15 * 8 + sat // 32)[inside], minlength=96).astype(float)
                want = bins / np.linalg.norm(bins)
        assert (got.hist is None) == (want is None) and (want is None or np.allclose(got.hist, want))
        assert got.bbox_area == (None if box is None else max(0.0, (box[2] - box[0] + 1) * (box[3] - box[1] + 1)))


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)] + [(5, 5), (None, 4)]
    with Scratch(spark) as scratch:
        got = {x.node: x.root for x in components(scratch, spark.createDataFrame(links, "a int, b int")).collect()}
    group = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = group.get(a, {a}), group.get(b, {b})
            for v in x | y:
                group[v] = x | y
    assert got == {v: min(g) for v, g in group.items()}


def _plain_edges(a):
    g = np.pad(colour.grey_14(a), 1, "edge").tolist()
    h, w = a.shape[:2]
    dx, dy, m = ({} for _ in range(3))
    for y in range(h):
        for x in range(w):
            p = lambda j, i, y=y, x=x: g[y + 1 + j][x + 1 + i]
            dx[y, x] = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
            dy[y, x] = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
            m[y, x] = abs(dx[y, x]) + abs(dy[y, x])
    of = lambda y, x: m.get((y, x), 0)
    ridge = {}
    for (y, x), v in m.items():
        if v <= 60:
            continue
        slope = abs(dy[y, x]) / abs(dx[y, x]) if dx[y, x] else math.inf
        if slope < math.tan(math.pi / 8):
            keep = v > of(y, x - 1) and v >= of(y, x + 1)
        elif slope > math.tan(3 * math.pi / 8):
            keep = v > of(y - 1, x) and v >= of(y + 1, x)
        else:
            s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
            keep = v > of(y - 1, x - s) and v > of(y + 1, x + s)
        if keep:
            ridge[y, x] = v
    found, todo = set(), [k for k, v in ridge.items() if v > 160]
    while todo:
        y, x = todo.pop()
        if (y, x) in ridge and (y, x) not in found:
            found.add((y, x))
            todo += [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    return found


def _plain_outer(found, h, w):
    regions_, left = [], set(found)
    while left:
        own, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for k in [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]:
                if k in left:
                    left.remove(k)
                    todo.append(k)
        regions_.append(own)
    outside, todo = set(), [(-1, -1)]
    while todo:
        k = todo.pop()
        if k not in outside and k not in found and -1 <= k[0] <= h and -1 <= k[1] <= w:
            outside.add(k)
            todo += [(k[0] + j, k[1] + i) for j, i in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    return [r for r in regions_ if any((y + j, x + i) in outside for y, x in r for j, i in ((0, 1), (1, 0), (0, -1), (-1, 0)))], regions_


@pytest.mark.parametrize("size", [6, 64])
def test_number_regions(spark, images, size):
    tiles = rasters.tiles(_frame(spark, images), size)
    with Scratch(spark) as scratch:
        outer, whole = (d.collect() for d in regions.outer_regions(scratch, tiles, size))
    metrics = {r.image: r for r in regions.number_region_metrics(tiles, size).collect()}
    enclosed = 0
    for k, a in images.items():
        h, w = a.shape[:2]
        edges = _plain_edges(a)
        free, every = _plain_outer(edges, h, w)
        box = lambda r: (min(x for _, x in r), min(y for y, _ in r), max(x for _, x in r), max(y for y, _ in r), len(r))
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in whole if r.image == k) == sorted(map(box, every))
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in outer if r.image == k) == sorted(map(box, free))
        enclosed += len(every) - len(free)
        digits = []
        for x0, y0, x1, y1, _ in map(box, free):
            bw, bh = x1 - x0 + 1, y1 - y0 + 1
            if 0.03 <= bw / w <= 0.55 and 0.15 <= bh / h <= 0.88 and 0.004 <= bw * bh / (w * h) <= 0.30 and 0.10 <= bw / bh <= 1.45 and 0.12 <= (x0 + bw / 2) / w <= 0.88:
                digits.append((x0, y0, bw, bh))
        m = metrics[k]
        assert sorted(map(tuple, m.digit_like_components)) == sorted(digits) and m.digit_like_component_count == len(digits)
        contrast, density = min(1.0, colour.grey_14(a).std() / 64), len(edges) / (h * w)
        assert math.isclose(m.contrast_score, contrast, abs_tol=1e-9) and math.isclose(m.edge_density, density, abs_tol=1e-12)
        assert math.isclose(m.number_visibility_signal, min(1.0, 0.42 * contrast + 0.36 * min(1.0, density / 0.16) + 0.22 * min(1.0, len(digits) / 2)), abs_tol=1e-9)
    assert enclosed >= 2 and sum(m.digit_like_component_count for m in metrics.values()) >= 2


def test_queries_cut_few_tiles(spark):
    """Rasters of the queries are cut as the library cuts them, not into more rows than that."""
    from trackloom.plans import images

    held = images._tiles(spark, "/root/testdata/sf0.001").selectExpr("ceil(height / 64) as most", "image").collect()
    assert len(held) == sum({r.image: r.most for r in held}.values())
