"""Rasters as rows of tiles: cutting, exchange of borders, visits of tiles.

A raster is a row (image, width, height, channels, pixels), pixels row by row
with the channels of a pixel together. Work is done on tiles of it, so no task
holds more than one tile with its border, whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels on a tile's side.
SIZE = 64
RASTER = "image long, width int, height int, channels int, pixels binary"
TILES = "image long, width int, height int, channels int, ty int, tx int, pixels binary"
#: Bytes of rows that are handed on at once.
BATCH = 1 << 22
_KEY = ["image", "ty", "tx"]


class Tile(NamedTuple):
    """Where a tile lies: the raster and its size, the tile's place in the grid, its first pixel and its own size."""

    image: int
    width: int
    height: int
    ty: int
    tx: int
    y0: int
    x0: int
    h: int
    w: int


def raster_of_bytes(rows: DataFrame, image: str, content: Column, width: int, channels: int = 3) -> DataFrame:
    """Rows as rasters of a fixed width made of their bytes; the last line is filled up with zeros. Null content is an empty raster."""
    line = width * channels
    held = F.coalesce(content, F.lit(b""))
    height = F.ceil(F.octet_length(held) / line).cast("int")
    return rows.select(F.col(image).cast("long").alias("image"), F.lit(width).alias("width"), height.alias("height"), F.lit(channels).alias("channels"), F.rpad(held, height * line, F.lit(b"\x00")).alias("pixels"))


def _pixmaps(batches):
    for batch in batches:
        out = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fields, at = [], 0
            while len(fields) < 4:  # magic, width, height, largest value; a comment runs to the end of its line
                while content[at : at + 1].isspace():
                    at += 1
                if content[at : at + 1] == b"#":
                    at = content.index(b"\n", at)
                    continue
                end = at
                while end < len(content) and not content[end : end + 1].isspace():
                    end += 1
                if end == at:
                    raise ValueError(f"{path}: not a portable pixmap")
                fields.append(content[at:end])
                at = end
            if fields[0] not in (b"P5", b"P6") or fields[3] != b"255":
                raise ValueError(f"{path}: not an 8-bit portable pixmap")
            width, height, channels = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
            pixels = content[at + 1 : at + 1 + width * height * channels]
            if len(pixels) != width * height * channels:
                raise ValueError(f"{path}: cut short")
            out.append((path, width, height, channels, pixels))
        yield _batch(out, "path string, width int, height int, channels int, pixels binary")


def pixmaps(spark: SparkSession, folder: str, pattern: str = "*.p[gp]m") -> DataFrame:
    """(path, width, height, channels, pixels) of the binary 8-bit pixmaps (P5, P6) of a folder; what isn't one raises, with its path."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return held.select("path", "content").mapInArrow(_pixmaps, "path string, width int, height int, channels int, pixels binary")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES |= {f"array<{k}>": pa.list_(t) for k, t in _TYPES.items()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _batches(rows: Iterator[tuple], schema: str, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows in batches of so many rows, or fewer where they hold large binaries or arrays."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, bytes) else v.nbytes for v in row if isinstance(v, (bytes, np.ndarray)))
        if len(held) >= most or size >= BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _place(image, width, height, ty, tx, size) -> Tile:
    return Tile(image, width, height, ty, tx, ty * size, tx * size, min(size, height - ty * size), min(size, width - tx * size))


def _array(pixels: bytes, h: int, w: int, channels: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(h, w, channels)


def tiles(rasters: DataFrame, size: int = SIZE) -> DataFrame:
    """The tiles of rasters: image, width, height, channels, ty, tx, pixels. Rasters without pixels have none, and null rasters neither."""

    def cut(batches):
        def each():
            for image, width, height, channels, pixels in _rows(batches):
                whole = _array(pixels, height, width, channels)
                for ty in range(-(-height // size)):
                    for tx in range(-(-width // size)):
                        yield image, width, height, channels, ty, tx, whole[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].tobytes()

        yield from _batches(each(), TILES)

    held = rasters.where("image is not null and pixels is not null and width > 0 and height > 0")
    return held.select(*[f.split()[0] for f in RASTER.split(", ")]).mapInArrow(cut, TILES)


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, *more)


def tile_rows(tiles_: DataFrame, kernel: Callable[[np.ndarray, Tile], list[tuple]], schema: str, size: int = SIZE) -> DataFrame:
    """What ``kernel`` makes of each tile alone; no shuffle."""

    def run(batches):
        def each():
            for image, width, height, channels, ty, tx, pixels in _rows(batches):
                t = _place(image, width, height, ty, tx, size)
                yield from kernel(_array(pixels, t.h, t.w, channels), t)

        yield from _batches(each(), schema)

    return tiles_.mapInArrow(run, schema)


def _bordered(t: Tile, channels: int, parts, radius: int, border: str) -> np.ndarray:
    """A tile with ``radius`` more pixels on every side, out of itself and its neighbours' strips: (dy, dx, pixels)."""

    def outside(n: int, low: int, high: int) -> np.ndarray:
        """For each of n positions the one within [low, high) that stands for it."""
        k = np.arange(n)
        if border == "mirror":
            k = np.where(k < low, 2 * low - k, np.where(k >= high, 2 * (high - 1) - k, k))
        return np.clip(k, low, high - 1)

    out = np.zeros((t.h + 2 * radius, t.w + 2 * radius, channels), np.uint8)
    top, left = min(radius, t.y0), min(radius, t.x0)
    bottom, right = min(radius, t.height - t.y0 - t.h), min(radius, t.width - t.x0 - t.w)
    rows = {-1: (radius - top, top), 0: (radius, t.h), 1: (radius + t.h, bottom)}
    columns = {-1: (radius - left, left), 0: (radius, t.w), 1: (radius + t.w, right)}
    for dy, dx, pixels in parts:
        (y, h), (x, w) = rows[dy], columns[dx]
        out[y : y + h, x : x + w] = _array(pixels, h, w, channels)
    return out[outside(len(out), radius - top, radius + t.h + bottom)][:, outside(out.shape[1], radius - left, radius + t.w + right)]


def whole(image: int, p: np.ndarray) -> Tile:
    """A raster as its only tile."""
    h, w = p.shape[:2]
    return Tile(image, w, h, 0, 0, 0, 0, h, w)


def widened(p: np.ndarray, radius: int, border: str = "edge") -> np.ndarray:
    """A whole raster with ``radius`` more pixels on every side, as ``stencil`` hands it to a kernel."""
    return _bordered(whole(0, p), p.shape[2], [(0, 0, p.tobytes())], radius, border)


def stencil(tiles_: DataFrame, kernel: Callable[[np.ndarray, Tile], list[tuple]], schema: str, radius: int = 1, border: str = "edge", size: int = SIZE) -> DataFrame:
    """What ``kernel`` makes of each tile with ``radius`` more pixels on every side.

    Every tile sends strips of its border to its neighbours, so a tile and its
    strips meet in one place. Outside the raster the nearest pixel is repeated
    (``edge``) or the raster is mirrored about its outermost pixels
    (``mirror``). ``radius`` is at most ``size``.
    """
    strips = "image long, width int, height int, channels int, ty int, tx int, dy int, dx int, pixels binary"

    def send(batches):
        part = lambda n, d: slice(None) if d == 0 else slice(0, radius) if d < 0 else slice(max(0, n - radius), n)

        def each():
            for image, width, height, channels, ty, tx, pixels in _rows(batches):
                t = _place(image, width, height, ty, tx, size)
                own = _array(pixels, t.h, t.w, channels)
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        if 0 <= ty + a < -(-height // size) and 0 <= tx + b < -(-width // size):
                            yield image, width, height, channels, ty + a, tx + b, -a, -b, own[part(t.h, a), part(t.w, b)].tobytes()

        yield from _batches(each(), strips)

    def run(batches):
        def each():
            held, key = [], None
            for image, width, height, channels, ty, tx, dy, dx, pixels in _rows(batches):
                now = (image, width, height, channels, ty, tx)
                if held and now != key:
                    yield from flush(key, held)
                    held = []
                key = now
                held.append((dy, dx, pixels))
            if held:
                yield from flush(key, held)

        def flush(key, held):
            image, width, height, channels, ty, tx = key
            t = _place(image, width, height, ty, tx, size)
            return kernel(_bordered(t, channels, held, radius, border), t)

        yield from _batches(each(), schema)

    return _dealt(tiles_.mapInArrow(send, strips)).mapInArrow(run, schema)


def visits(tiles_: DataFrame, asks: DataFrame, prepare: Callable, answer: Callable, schema: str, masks: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """What asks get from the tiles they name. ``asks`` has image, ty, tx and further columns of longs; ``prepare(pixels, mask, tile)`` is called once a tile and ``answer(prepared, tile, *further)`` once an ask.

    Asks come after their tile in one stream, so a task holds one tile,
    however many ask it. ``masks`` are tiles of one channel; a tile without a
    mask tile of the same raster size has none. Asks of tiles that do not
    exist get no answer.
    """
    further = [c for c in asks.columns if c not in _KEY]
    own = tiles_.withColumn("mask", F.lit(None).cast("binary"))
    if masks is not None:
        shapes = [*_KEY, "width", "height"]
        own = tiles_.join(masks.select(*shapes, F.col("pixels").alias("mask")), shapes, "left")
    own = own.select(*_KEY, F.lit(0).alias("kind"), "width", "height", "channels", "pixels", "mask", *[F.lit(None).cast("long").alias(c) for c in further])
    rest = asks.select(*[F.col(c).cast(t) for c, t in zip(_KEY, ("long", "int", "int"), strict=True)], F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("channels", "int"), ("pixels", "binary"), ("mask", "binary"))], *[F.col(c).cast("long") for c in further])

    def run(batches):
        def each():
            t = held = None
            for image, ty, tx, kind, width, height, channels, pixels, mask, *values in _rows(batches):
                if kind == 0:
                    t = _place(image, width, height, ty, tx, size)
                    held = prepare(_array(pixels, t.h, t.w, channels), None if mask is None else _array(mask, t.h, t.w, 1)[..., 0], t)
                elif t is not None and (t.image, t.ty, t.tx) == (image, ty, tx):
                    yield from answer(held, t, *values)

        yield from _batches(each(), schema)

    return _dealt(own.unionAll(rest), "kind").mapInArrow(run, schema)


PATCHES = "image long, width int, height int, channels int, oy int, ox int, oh int, ow int, pixels binary"


def assembled(patches: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of rasters given in rectangles of any size that cover them once: image, width, height, channels, the rectangle's first pixel oy, ox, its size oh, ow, and its pixels."""
    pieces = "image long, width int, height int, channels int, ty int, tx int, y int, x int, h int, w int, pixels binary"

    def cut(batches):
        def each():
            for image, width, height, channels, oy, ox, oh, ow, pixels in _rows(batches):
                own = _array(pixels, oh, ow, channels)
                for ty in range(oy // size, -(-(oy + oh) // size)):
                    for tx in range(ox // size, -(-(ox + ow) // size)):
                        y0, y1, x0, x1 = max(oy, ty * size), min(oy + oh, (ty + 1) * size), max(ox, tx * size), min(ox + ow, (tx + 1) * size)
                        yield image, width, height, channels, ty, tx, y0 - ty * size, x0 - tx * size, y1 - y0, x1 - x0, own[y0 - oy : y1 - oy, x0 - ox : x1 - ox].tobytes()

        yield from _batches(each(), pieces)

    def join(batches):
        def each():
            key, out = None, None
            for *now, y, x, h, w, pixels in _rows(batches):
                if now != key:
                    if key is not None:
                        yield (*key, out.tobytes())
                    key = now
                    image, width, height, channels, ty, tx = now
                    t = _place(image, width, height, ty, tx, size)
                    out = np.zeros((t.h, t.w, channels), np.uint8)
                out[y : y + h, x : x + w] = _array(pixels, h, w, now[3])
            if key is not None:
                yield (*key, out.tobytes())

        yield from _batches(each(), TILES)

    return _dealt(patches.mapInArrow(cut, pieces)).mapInArrow(join, TILES)


def cropped(tiles_: DataFrame, boxes: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of the parts of rasters that ``boxes`` (image, crop, box with whole inclusive corners within the raster) cut out; a part is a raster whose image is ``crop``."""
    b = F.col("box")
    at = {c: b[c].cast("long") for c in ("x0", "y0", "x1", "y1")}
    span = lambda a, z: F.sequence((at[a] / size).cast("int"), (at[z] / size).cast("int"))
    asks = boxes.where("box is not null").select("image", F.explode(span("y0", "y1")).alias("ty"), "crop", *[v.alias(c) for c, v in at.items()], span("x0", "x1").alias("xs")).withColumn("tx", F.explode("xs")).drop("xs")

    def part(p, t: Tile, crop, x0, y0, x1, y1):
        top, left, bottom, right = max(y0, t.y0), max(x0, t.x0), min(y1 + 1, t.y0 + t.h), min(x1 + 1, t.x0 + t.w)
        piece = p[top - t.y0 : bottom - t.y0, left - t.x0 : right - t.x0]
        return [(crop, x1 - x0 + 1, y1 - y0 + 1, p.shape[-1], top - y0, left - x0, bottom - top, right - left, piece.tobytes())]

    return assembled(visits(tiles_, asks.select("image", "ty", "tx", "crop", "x0", "y0", "x1", "y1"), lambda p, _, t: p, part, PATCHES, size=size), size)
