"""Enhanced variants against plain loops over whole rasters."""

import math

import numpy as np
import pytest
from test_rasters import _drawing, _frame, _noise

from trackloom import rasters
from trackloom.rasters import colour, variants

SIZE = 7


@pytest.fixture(scope="module")
def images():
    return {1: _drawing(1, 23, 31), 2: _noise(2, 12, 18), 3: _noise(3, 1, 5), 4: _noise(4, 6, 1), 5: np.full((9, 9, 3), 77, np.uint8), 6: _drawing(6, 18, 20)}


def _whole(tiles):
    out = {}
    for r in tiles.collect():
        a = out.setdefault(r.image, np.zeros((r.height, r.width, r.channels), np.uint8))
        h, w = a[r.ty * SIZE : (r.ty + 1) * SIZE, r.tx * SIZE : (r.tx + 1) * SIZE].shape[:2]
        a[r.ty * SIZE : r.ty * SIZE + h, r.tx * SIZE : r.tx * SIZE + w] = np.frombuffer(bytes(r.pixels), np.uint8).reshape(h, w, -1)
    return out


def _mirror(k, n):
    while not 0 <= k < n:
        k = 0 if n == 1 else -k if k < 0 else 2 * (n - 1) - k
    return k


def _contrast(g, clip):
    h, w = g.shape
    full = h % 6 == 0 and w % 6 == 0
    eh, ew = (n if full else n + 6 - n % 6 for n in (h, w))
    wide = [[int(g[_mirror(y, h), _mirror(x, w)]) for x in range(ew)] for y in range(eh)]
    th, tw = eh // 6, ew // 6
    tables = {}
    for j in range(6):
        for i in range(6):
            counts = [0] * 256
            for y in range(j * th, (j + 1) * th):
                for x in range(i * tw, (i + 1) * tw):
                    counts[wide[y][x]] += 1
            most, over = max(int(clip * th * tw / 256), 1), 0
            for v in range(256):
                over += max(0, counts[v] - most)
                counts[v] = min(counts[v], most)
            counts = [c + over // 256 for c in counts]
            rest = over % 256
            at, step = 0, max(256 // rest, 1) if rest else 1
            while at < 256 and rest > 0:
                counts[at] += 1
                at, rest = at + step, rest - 1
            total, table = 0, []
            for c in counts:
                total += c
                table.append(min(255, round(total * (255.0 / (th * tw)))))
            tables[j, i] = table
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            fx, fy = x / tw - 0.5, y / th - 0.5
            x1, y1 = math.floor(fx), math.floor(fy)
            a, b = fx - x1, fy - y1
            t = lambda j, i, v=int(g[y, x]): tables[min(5, max(0, j)), min(5, max(0, i))][v]
            out[y, x] = round((t(y1, x1) * (1 - a) + t(y1, x1 + 1) * a) * (1 - b) + (t(y1 + 1, x1) * (1 - a) + t(y1 + 1, x1 + 1) * a) * b)
    return out


def _otsu(g):
    best, level = 0.0, 0
    flat = g.ravel().astype(float)
    for k in range(256):
        low, high = flat[flat <= k], flat[flat > k]
        if len(low) and len(high):
            between = len(low) / len(flat) * len(high) / len(flat) * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12) + 1e-12:
                best, level = between, k
    return level


def _large(a, new_h, new_w):
    def weights(x):
        f = lambda d: (1.25 * d - 2.25) * d * d + 1 if d <= 1 else -0.75 * (((d - 5) * d + 8) * d - 4)
        return [round(2048 * f(d)) for d in (1 + x, x, 1 - x)] + [round(2048 * (1 - f(1 + x) - f(x) - f(1 - x)))]

    h, w, c = a.shape
    out = np.zeros((new_h, new_w, c), np.uint8)
    for y in range(new_h):
        fy = (y + 0.5) * h / new_h - 0.5
        for x in range(new_w):
            fx = (x + 0.5) * w / new_w - 0.5
            total = np.zeros(c, np.int64)
            for j, wy in enumerate(weights(fy - math.floor(fy))):
                for i, wx in enumerate(weights(fx - math.floor(fx))):
                    total += a[min(h - 1, max(0, math.floor(fy) - 1 + j)), min(w - 1, max(0, math.floor(fx) - 1 + i))].astype(np.int64) * wy * wx
            out[y, x] = np.clip((total + (1 << 21)) >> 22, 0, 255)
    return out


def _sharp(a):
    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.1 * 1.1))
    k /= k.sum()
    h, w, _ = a.shape
    wide = np.array([[sum(a[y, _mirror(x + i - 4, w)].astype(float) * k[i] for i in range(9)) for x in range(w)] for y in range(h)])
    soft = np.rint(np.array([[sum(wide[_mirror(y + i - 4, h), x] * k[i] for i in range(9)) for x in range(w)] for y in range(h)]))
    return np.clip(np.rint(a * 1.8 - soft * 0.8), 0, 255).astype(np.uint8)


def _same(got, want, off=0.0):
    """Equal, but for a part ``off`` of the pixels that differ by one: sums in another order may round the other way."""
    assert got.shape == want.shape
    apart = np.abs(got.astype(int) - want.astype(int))
    assert apart.max(initial=0) <= (1 if off else 0) and (apart > 0).mean() <= off


def test_parts_and_contrast(spark, images):
    tiles = rasters.tiles(_frame(spark, images), SIZE)
    for k, a in _whole(variants.grey(tiles, SIZE)).items():
        _same(a[..., 0], colour.grey_14(images[k]).astype(np.uint8))
    greys = variants.grey(tiles, SIZE)
    contrast, binary = _whole(variants.local_contrast(greys, 2.4, SIZE)), _whole(variants.thresholded(greys, False, SIZE))
    for k, a in images.items():
        g = colour.grey_14(a).astype(np.uint8)
        _same(contrast[k][..., 0], _contrast(g, 2.4), 0.01)
        _same(binary[k][..., 0], np.where(g > _otsu(g), 255, 0).astype(np.uint8))


def test_enlarged_and_sharpened(spark, images):
    tiles = rasters.tiles(_frame(spark, images), SIZE)
    large, tall, sharp = (_whole(t) for t in (variants.enlarged(tiles, 3, SIZE), variants.enlarged(tiles, 1.0, SIZE, tall=30.0), variants.sharpened(tiles, size=SIZE)))
    for k, a in images.items():
        h, w = a.shape[:2]
        _same(large[k], _large(a, 3 * h, 3 * w), 0.001)
        by = max(2.0, min(5.0, 30.0 / h))
        _same(tall[k], _large(a, round(h * by), round(w * by)), 0.001)
        if min(h, w) > 4:
            _same(sharp[k], _sharp(a), 0.001)


def test_eight_variants(spark, images):
    some = {k: a for k, a in images.items() if min(a.shape[:2]) > 6}
    tiles = rasters.tiles(_frame(spark, some), SIZE)
    guess = {1: (5.0, 3.0, 14.2, 12.0), 2: None, 5: (-3.0, 2.0, 30.0, 30.0), 6: (2.0, 2.0, 3.0, 3.0)}
    rows = [(k, a.shape[1], a.shape[0], k % 2 == 0, guess[k]) for k, a in some.items()]
    crops = spark.createDataFrame(rows, "image long, width int, height int, torso boolean, box struct<x0: double, y0: double, x1: double, y1: double>")
    found = variants.enhanced_variants(crops, tiles, 2, SIZE)
    assert len(found) == 8
    boxes = {(r.image, r.variant): r.box for r in variants.region_boxes(crops).collect()}
    parts = {n: _whole(found[n]) for n in found}
    for k, a in some.items():
        for n in ("wider_torso_rgb", "upper_center_torso_rgb", "center_chest_back_rgb"):
            b = boxes[k, n]
            _same(parts[n][k], a[int(b.y0) : int(b.y1) + 1, int(b.x0) : int(b.x1) + 1])
        centre = parts["center_chest_back_rgb"][k]
        h, w = centre.shape[:2]
        _same(parts["center_enlarged_rgb"][k], _large(centre, 2 * h, 2 * w), 0.001)
        assert (parts["center_threshold_binary_upscaled"][k] ^ parts["center_threshold_inverted_upscaled"][k] == 255).all()
        g = parts["center_contrast_gray_upscaled"][k]
        _same(parts["center_threshold_binary_upscaled"][k], np.where(g > _otsu(g), 255, 0).astype(np.uint8))
    forms = variants.preprocessing_variants(tiles, SIZE)
    assert {n: m for n, (_, m) in forms.items()} == {"original": [7], "grayscale": [7], "contrast_enhanced": [7, 8], "thresholded": [8, 13], "enlarged_upscaled": [7, 8]}
    for r in variants.digests(tiles, SIZE).collect():
        flat = some[r.image].ravel().astype(int)
        assert r.digest == sum((v + 1) * ((k * 40503 + 12345) % 65521) for k, v in enumerate(flat.tolist()))


@pytest.mark.parametrize("kind", ["enhanced", "forms"])
def test_whole_rasters_as_tiles(spark, monkeypatch, images, kind):
    """Rasters that are not cut give what their tiles give, without a shuffle."""
    some = _frame(spark, {k: a for k, a in images.items() if k in (1, 2, 4, 6)})
    if kind == "enhanced":
        crops = some.selectExpr("*", "image % 2 = 0 AS torso", "IF(image = 2, NULL, named_struct('x0', 2D, 'y0', 1D, 'x1', 9D, 'y1', 7D)) AS box")
        made = lambda: variants.enhanced_digests(crops, 2, SIZE)
    else:
        made = lambda: variants.form_digests(some, SIZE)
    got = made()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(variants, "WHOLE", 300)  # images 1 and 6 are cut
    cut = made()
    assert "Exchange" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, cut.select(got.columns).collect())) == whole
    assert len(whole) == 4 * (8 if kind == "enhanced" else 5)


def test_queries_shuffle_no_pictures(spark):
    from trackloom.plans import images as queries

    for query in (queries.number_variants, queries.reading_forms):
        assert "Exchange" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
