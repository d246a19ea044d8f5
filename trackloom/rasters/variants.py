"""Enhanced variants of number regions: local contrast, thresholds, enlargement, sharpening.

What depends on a whole raster (histograms of the contrast grid and of the
threshold) is counted tile by tile and added up; the rest needs a tile and a
few pixels round it. Fixed values: clip limits, grids, kernels and weights.
Roundings that depend on the word size of another library's floats are taken
in double precision here.

Rasters of up to ``WHOLE`` pixels, which a row holds anyway, get all their
variants' digests in the task that reads them, by the kernels of the tiles:
nothing is shuffled for them. Larger ones go tile by tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from . import PATCHES, SIZE, TILES, Tile, _array, _batches, _place, _rows, assembled, cropped, stencil, tile_rows, whole, widened
from . import tiles as tiles_of
from .colour import grey_14

GRID = 6
#: Pixels of a raster that is not cut into tiles.
WHOLE = 1 << 17


def grey(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of one channel, by luma."""
    return tile_rows(tiles, lambda p, t: [(t.image, t.width, t.height, 1, t.ty, t.tx, grey_14(p).astype(np.uint8).tobytes())], TILES, size)


def _mirrored(n: int, low: int, high: int) -> np.ndarray:
    """The position in [0, n) that each of [low, high) stands for when a line is mirrored about its ends."""
    if n == 1:
        return np.zeros(high - low, np.int64)
    k = np.arange(low, high) % (2 * (n - 1))
    return np.where(k < n, k, 2 * (n - 1) - k)


def _grid(width: int, height: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The source column and line of each position of the raster filled up to whole cells of the grid, and a cell's size. Where one side has to be filled up, the other is as well, by a whole cell's worth of lines if it need not be."""
    more = width % grid or height % grid
    wide, tall = (n + grid - n % grid if more else n for n in (width, height))
    return _mirrored(width, 0, wide), _mirrored(height, 0, tall), wide // grid, tall // grid


def clipped_table(counts: np.ndarray, clip: float) -> np.ndarray:
    """What each value becomes under the equalised histogram of a cell, whose counts are cut at ``clip`` times their mean and given out evenly."""
    n = int(counts.sum())
    most = max(int(clip * n / 256), 1)
    over = int(np.maximum(counts - most, 0).sum())
    held = np.minimum(counts, most) + over // 256
    rest = over % 256
    if rest:
        step = max(256 // rest, 1)
        held[np.arange(0, 256, step)[:rest]] += 1
    return np.clip(np.rint(np.cumsum(held) * (255.0 / n)), 0, 255).astype(np.uint8)


def _cell_counts(p: np.ndarray, t: Tile) -> np.ndarray:
    """How often each value is in each cell of the contrast grid, as far as it lies in the tile: counts of cell x 256 + value."""
    xs, ys, wide, tall = _grid(t.width, t.height)
    own_x, own_y = (np.flatnonzero((v >= a) & (v < a + n)) for v, a, n in ((xs, t.x0, t.w), (ys, t.y0, t.h)))
    cell = (own_y // tall)[:, None] * GRID + (own_x // wide)[None, :]
    value = p[..., 0][ys[own_y] - t.y0][:, xs[own_x] - t.x0]
    return np.bincount((cell * 256 + value).ravel(), minlength=GRID * GRID * 256)


def _tables(counts: np.ndarray, clip: float) -> np.ndarray:
    return np.stack([clipped_table(c, clip) for c in counts])


def _blended(value: np.ndarray, tables: np.ndarray, t: Tile) -> np.ndarray:
    table = tables.reshape(GRID, GRID, 256).astype(float)
    _, _, wide, tall = _grid(t.width, t.height)
    x, y = (np.arange(t.x0, t.x0 + t.w) / wide - 0.5)[None, :], (np.arange(t.y0, t.y0 + t.h) / tall - 0.5)[:, None]
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    a, b = x - left, y - top
    at = lambda j, i: table[np.clip(j, 0, GRID - 1), np.clip(i, 0, GRID - 1), value]
    mixed = (at(top, left) * (1 - a) + at(top, left + 1) * a) * (1 - b) + (at(top + 1, left) * (1 - a) + at(top + 1, left + 1) * a) * b
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def local_contrast(greys: DataFrame, clip: float, size: int = SIZE) -> DataFrame:
    """Tiles of one channel under contrast-limited adaptive equalisation in a grid of six by six cells, whose tables are blended from cell to cell."""
    schema = "image long, cell long, value long, n long"

    def count(p: np.ndarray, t: Tile):
        n = _cell_counts(p, t)
        return [(t.image, int(k) >> 8, int(k) & 255, int(n[k])) for k in np.flatnonzero(n)]

    sums = tile_rows(greys, count, schema, size).groupBy("image", "cell", "value").agg(F.sum("n").alias("n"))
    held = sums.groupBy("image").agg(F.collect_list(F.struct("cell", "value", "n")).alias("bins"))  # 36 x 256 at most

    def tables(batches):
        def each():
            for image, bins in _rows(batches):
                counts = np.zeros((GRID * GRID, 256), np.int64)
                for b in bins:
                    counts[b["cell"], b["value"]] = b["n"]
                yield image, _tables(counts, clip).tobytes()

        yield from _batches(each(), "image long, tables binary")

    def apply(batches):
        def each():
            for image, width, height, channels, ty, tx, pixels, held in _rows(batches):
                t = _place(image, width, height, ty, tx, size)
                mixed = _blended(_array(pixels, t.h, t.w, channels)[..., 0], np.frombuffer(held, np.uint8), t)
                yield image, width, height, 1, ty, tx, mixed.tobytes()

        yield from _batches(each(), TILES)

    met = greys.join(held.mapInArrow(tables, "image long, tables binary"), "image")
    return met.select(*greys.columns, "tables").mapInArrow(apply, TILES)


def best_threshold(counts: np.ndarray) -> int:
    """The value that parts a histogram with the largest variance between the two sides, the first of equals; zero where there is one value only."""
    p = counts / counts.sum()
    mean, low, share, best, found = float((np.arange(256) * p).sum()), 0.0, 0.0, 0.0, 0
    for k in range(256):
        low, share = low * share + k * float(p[k]), share + float(p[k])
        if min(share, 1 - share) < np.finfo(np.float32).eps:
            low = low / share if share > 0 else 0.0
            continue
        low /= share
        between = share * (1 - share) * (low - (mean - share * low) / (1 - share)) ** 2
        if between > best:
            best, found = between, k
    return found


def thresholded(greys: DataFrame, inverted: bool = False, size: int = SIZE) -> DataFrame:
    """Tiles of one channel that are 255 above the raster's best threshold and 0 else, or the other way round."""
    schema = "image long, value long, n long"

    def count(p: np.ndarray, t: Tile):
        n = np.bincount(p.ravel(), minlength=256)
        return [(t.image, int(k), int(n[k])) for k in np.flatnonzero(n)]

    sums = tile_rows(greys, count, schema, size).groupBy("image", "value").agg(F.sum("n").alias("n")).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("bins"))

    def find(batches):
        yield from _batches(((image, best_threshold(np.bincount([k for k, _ in bins], [n for _, n in bins], 256))) for image, bins in _rows(batches)), "image long, level int")

    def apply(batches):
        def each():
            for image, width, height, channels, ty, tx, pixels, level in _rows(batches):
                above = np.frombuffer(pixels, np.uint8) > level
                yield image, width, height, channels, ty, tx, np.where(above != inverted, 255, 0).astype(np.uint8).tobytes()

        yield from _batches(each(), TILES)

    met = greys.join(sums.mapInArrow(find, "image long, level int"), "image")
    return met.select(*greys.columns, "level").mapInArrow(apply, TILES)


def _cubic(fractions: np.ndarray) -> np.ndarray:
    """Weights of the four pixels round a point, with 11 bits behind the point (the cubic with a slope of -0.75)."""
    a, x = -0.75, fractions
    one, two = ((a * (x + 1) - 5 * a) * (x + 1) + 8 * a) * (x + 1) - 4 * a, ((a + 2) * x - (a + 3)) * x * x + 1
    three = ((a + 2) * (1 - x) - (a + 3)) * (1 - x) * (1 - x) + 1
    return np.rint(np.stack([one, two, three, 1 - one - two - three]) * 2048).astype(np.int64)


def _cubed(p: np.ndarray, t: Tile, scale: float, tall: float | None) -> tuple[int, int, int, int, np.ndarray] | None:
    """What a tile with a border of two adds to the enlarged raster: that one's width and height, the line and column of the first pixel, the pixels."""
    by = scale if tall is None else max(2.0, min(5.0, tall / max(t.height, 1)))
    width, height = (max(1, round(n * by)) for n in (t.width, t.height))
    sides = []
    for n, new, first, count in ((t.height, height, t.y0, t.h), (t.width, width, t.x0, t.w)):
        out = np.arange(-(-first * new // n), -(-(first + count) * new // n))
        at = (out + 0.5) * n / new - 0.5
        low = np.floor(at).astype(int)
        # Positions within the tile with its border, outermost pixels repeated.
        sides.append((out, _cubic(at - low), np.clip(low[None, :] + np.arange(-1, 3)[:, None], 0, n - 1) - first + 2))
    (oy, wy, sy), (ox, wx, sx) = sides
    if not len(oy) or not len(ox):
        return None
    wide = sum(p[:, sx[k]].astype(np.int64) * wx[k][None, :, None] for k in range(4))
    whole = sum(wide[sy[k]] * wy[k][:, None, None] for k in range(4))
    pixels = np.clip((whole + (1 << 21)) >> 22, 0, 255).astype(np.uint8)
    return width, height, int(oy[0]), int(ox[0]), pixels


def enlarged(tiles: DataFrame, scale: float, size: int = SIZE, tall: float | None = None) -> DataFrame:
    """Tiles of rasters ``scale`` times as wide and high (rounded half to even, one pixel at least), by bicubic interpolation with the outermost pixels repeated. With ``tall`` the scale is so that a raster gets about that high, from 2 to 5.

    A pixel belongs to the tile that holds its own place in the source, two
    pixels more on each side are all it needs.
    """

    def kernel(p: np.ndarray, t: Tile):
        made = _cubed(p, t, scale, tall)
        return [] if made is None else [(t.image, *made[:2], p.shape[-1], *made[2:4], *made[4].shape[:2], made[4].tobytes())]

    return assembled(stencil(tiles, kernel, PATCHES, radius=2, size=size), size)


#: The blur's width, and the weights of a pixel and of its blur.
SIGMA, OWN, BLURRED = 1.1, 1.8, -0.8


def _gaussian(sigma: float) -> np.ndarray:
    radius = (round(sigma * 6 + 1) | 1) // 2
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _less_blur(p: np.ndarray, t: Tile, k: np.ndarray, own: float, blurred: float) -> np.ndarray:
    radius = len(k) // 2
    wide = sum(p[:, i : i + t.w].astype(float) * k[i] for i in range(len(k)))
    soft = np.rint(sum(wide[i : i + t.h] * k[i] for i in range(len(k))))
    mixed = p[radius : radius + t.h, radius : radius + t.w] * own + soft * blurred
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def sharpened(tiles: DataFrame, sigma: float = SIGMA, own: float = OWN, blurred: float = BLURRED, size: int = SIZE) -> DataFrame:
    """Tiles less their Gaussian blur, by weights; rasters are mirrored about their outermost pixels."""
    k = _gaussian(sigma)

    def kernel(p: np.ndarray, t: Tile):
        return [(t.image, t.width, t.height, p.shape[-1], t.ty, t.tx, _less_blur(p, t, k, own, blurred).tobytes())]

    return stencil(tiles, kernel, TILES, radius=len(k) // 2, border="mirror", size=size)


def _digest(p: np.ndarray, t: Tile) -> int:
    c = p.shape[-1]
    place = ((t.y0 + np.arange(t.h))[:, None, None] * t.width + (t.x0 + np.arange(t.w))[None, :, None]) * c + np.arange(c)
    return int(((p.astype(np.int64) + 1) * ((place * 40503 + 12345) % 65521)).sum())


def digests(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """image, width, height, channels and a digest: the sum over all bytes of value + 1 times (place x 40503 + 12345) modulo 65521."""
    schema = "image long, width int, height int, channels int, digest long"

    def kernel(p: np.ndarray, t: Tile):
        return [(t.image, t.width, t.height, p.shape[-1], _digest(p, t))]

    return tile_rows(tiles, kernel, schema, size).groupBy("image", "width", "height", "channels").agg(F.sum("digest").alias("digest"))


def region_boxes(sizes: DataFrame, guess: str = "box", torso: str = "torso") -> DataFrame:
    """(image, variant, box) of the three spatial variants of a crop: ``sizes`` has image, width, height, whether it is a torso, and the guessed number box or null. The parts."""
    found = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("variant"), b.alias("box")) for k, (n, b) in enumerate(_regions(guess, torso))])
    return sizes.select("image", F.explode(found).alias("v")).select("image", "v.*")


def _regions(guess: str, torso: str) -> list[tuple[str, Column]]:
    w, h, t = F.col("width"), F.col("height"), F.coalesce(F.col(torso), F.lit(False))
    either = lambda a, b: F.when(t, bx.fractional(w, h, *a)).otherwise(bx.fractional(w, h, *b))
    return [("wider_torso_rgb", either((0.0, 0.0, 1.0, 1.0), (0.04, 0.02, 0.96, 0.74))), ("upper_center_torso_rgb", either((0.06, 0.0, 0.94, 0.76), (0.12, 0.02, 0.88, 0.64))), ("center_chest_back_rgb", bx.padded_audit(F.col(guess), w, h))]


def enhanced_variants(crops: DataFrame, tiles: DataFrame, scale: int = 3, size: int = SIZE) -> dict[str, DataFrame]:
    """Tiles of the eight variants by name: three parts of a crop, and five treatments of the last of them. ``crops``: image (not negative), width, height, torso, box."""
    boxes = region_boxes(crops)
    parts = cropped(tiles, boxes.withColumn("crop", F.col("image") * 4 + F.col("place")), size)
    of = lambda k: parts.where(F.col("image") % 4 == k).withColumn("image", F.expr("image div 4"))
    centre = of(2)
    contrast = enlarged(local_contrast(grey(centre, size), 2.4, size), scale, size)
    large = enlarged(centre, scale, size)
    return {
        "wider_torso_rgb": of(0), "upper_center_torso_rgb": of(1), "center_chest_back_rgb": centre,
        "center_contrast_gray_upscaled": contrast, "center_threshold_binary_upscaled": thresholded(contrast, False, size), "center_enlarged_rgb": large,
        "center_sharpened_rgb_upscaled": sharpened(large, size=size), "center_threshold_inverted_upscaled": thresholded(contrast, True, size)}


#: The page modes in which each form is read.
FORMS = {"original": [7], "grayscale": [7], "contrast_enhanced": [7, 8], "thresholded": [8, 13], "enlarged_upscaled": [7, 8]}


def preprocessing_variants(tiles: DataFrame, size: int = SIZE) -> dict[str, tuple[DataFrame, list[int]]]:
    """Tiles of the five forms in which a region is read, by name, each with the page modes it is read in."""
    plain = grey(tiles, size)
    contrast = local_contrast(plain, 2.3, size)
    found = (tiles, plain, contrast, thresholded(contrast, False, size), enlarged(contrast, 1.0, size, tall=200.0))
    return {name: (held, modes) for held, (name, modes) in zip(found, FORMS.items(), strict=True)}


def _contrasted(grey_: np.ndarray, clip: float) -> np.ndarray:
    t = whole(0, grey_)
    return _blended(grey_[..., 0], _tables(_cell_counts(grey_, t).reshape(-1, 256), clip), t)[..., None]


def _enlarged(p: np.ndarray, scale: float, tall: float | None = None) -> np.ndarray:
    return _cubed(widened(p, 2), whole(0, p), scale, tall)[4]


def _above(grey_: np.ndarray) -> np.ndarray:
    return grey_ > best_threshold(np.bincount(grey_.ravel(), minlength=256))


def _grey(p: np.ndarray) -> np.ndarray:
    return grey_14(p).astype(np.uint8)[..., None]


def _black_white(held: np.ndarray) -> np.ndarray:
    return np.where(held, 255, 0).astype(np.uint8)


def _eight(p: np.ndarray, boxes: list, scale: float):
    """``enhanced_variants`` of one raster: (name, pixels). ``boxes`` are the corners of its three parts, or null."""
    parts = [None if any(v is None for v in b) else p[b[1] : b[3] + 1, b[0] : b[2] + 1] for b in boxes]
    yield from ((n, v) for n, v in zip(("wider_torso_rgb", "upper_center_torso_rgb", "center_chest_back_rgb"), parts, strict=True) if v is not None)
    centre = parts[2]
    if centre is None:
        return
    contrast, large, k = _enlarged(_contrasted(_grey(centre), 2.4), scale), _enlarged(centre, scale), _gaussian(SIGMA)
    above = _above(contrast)
    yield from (("center_contrast_gray_upscaled", contrast), ("center_threshold_binary_upscaled", _black_white(above)), ("center_enlarged_rgb", large))
    yield from (("center_sharpened_rgb_upscaled", _less_blur(widened(large, len(k) // 2, "mirror"), whole(0, large), k, OWN, BLURRED)), ("center_threshold_inverted_upscaled", _black_white(~above)))


def _five(p: np.ndarray):
    """``preprocessing_variants`` of one raster: (name, pixels)."""
    plain = _grey(p)
    contrast = _contrasted(plain, 2.3)
    return [("original", p), ("grayscale", plain), ("contrast_enhanced", contrast), ("thresholded", _black_white(_above(contrast))), ("enlarged_upscaled", _enlarged(contrast, 1.0, 200.0))]


_DIGESTS = "image long, variant string, width int, height int, channels int, digest long"


def _digested(rasters: DataFrame, size: int, made, tiled, *more: Column) -> DataFrame:
    """The digests of what ``made(pixels, *more)`` gives for rasters of up to ``WHOLE`` pixels, without a shuffle, and of what ``tiled(rasters)`` gives by name for larger ones."""

    def run(batches):
        def each():
            for image, width, height, channels, pixels, *values in _rows(batches):
                for name, p in made(_array(pixels, height, width, channels), *values):
                    yield image, name, p.shape[1], p.shape[0], p.shape[2], _digest(p, whole(image, p))

        yield from _batches(each(), _DIGESTS)

    held = rasters.where("image is not null and pixels is not null and width > 0 and height > 0")
    pixels = F.col("width").cast("long") * F.col("height")
    out = held.where(pixels <= WHOLE).select("image", "width", "height", "channels", "pixels", *more).mapInArrow(run, _DIGESTS)
    large = held.where(pixels > WHOLE)
    if large.isEmpty():
        return out
    for name, tiles in tiled(large).items():
        out = out.unionByName(digests(tiles, size).withColumn("variant", F.lit(name)))
    return out


def enhanced_digests(crops: DataFrame, scale: int = 3, size: int = SIZE) -> DataFrame:
    """image, variant, width, height, channels, digest of ``enhanced_variants``; ``crops`` are rasters with torso and box."""
    corners = F.array(*[F.array(*[b[c].cast("long") for c in ("x0", "y0", "x1", "y1")]) for _, b in _regions("box", "torso")]).alias("boxes")
    tiled = lambda large: enhanced_variants(large.select("image", "width", "height", "torso", "box"), tiles_of(large, size), scale, size)
    return _digested(crops, size, lambda p, boxes: _eight(p, boxes, scale), tiled, corners)


def form_digests(rasters: DataFrame, size: int = SIZE) -> DataFrame:
    """image, variant, width, height, channels, digest of ``preprocessing_variants``, with their modes."""
    tiled = lambda large: {n: t for n, (t, _) in preprocessing_variants(tiles_of(large, size), size).items()}
    modes = F.create_map(*[F.lit(v) for n, m in FORMS.items() for v in (n, ",".join(map(str, m)))])
    return _digested(rasters, size, _five, tiled).withColumn("modes", modes[F.col("variant")])
