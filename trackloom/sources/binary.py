"""Sources that read parts of binary files: rows of arrays by ranges of bytes, headers of videos.

Files are listed and opened through Arrow's file systems, so a path is local
or a URI that they know. A partition is a range of one file; a task seeks to
it and reads no more.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.components import Scratch
from ..operators.select import evenly_picked
from ..rasters.fusion import usable


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, pattern: str) -> list[str]:
    """The files of a folder that match, or the file itself, in the order of names."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, rows: int, offset: int, width: int, dtype: str):
        self.path, self.start, self.rows, self.offset, self.width, self.dtype = path, start, rows, offset, width, dtype


def array_header(handle) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of an array's data; what isn't a C-ordered array of numbers raises."""
    version = np.lib.format.read_magic(handle)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(handle)
    if fortran and len(shape) > 1 or dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError("not a C-ordered array of numbers")
    return shape, dtype, handle.tell()


class ArrayRows(DataSource):
    """Rows of .npy arrays: path, at, values. All dimensions but the last are flattened; one of a single dimension has rows of one value.

    Options: path (a folder or a file), pattern, rows (of a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "path string, at long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options)


class _ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern, self.rows = options["path"], options.get("pattern", "*.npy"), int(options.get("rows", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        out, store = [], _store(self.folder)[0]
        for path in _listed(self.folder, self.pattern):
            with store.open_input_file(path) as handle:
                try:
                    shape, dtype, offset = array_header(handle)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
            width = shape[-1] if len(shape) > 1 else 1
            total = int(np.prod(shape, dtype=np.int64)) // width if width else 0
            out += [_Range(path, at, min(self.rows, total - at), offset, width, dtype.str) for at in range(0, total, self.rows)]
        return out or [_Range("", 0, 0, 0, 1, "<f8")]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        dtype, step = np.dtype(part.dtype), max(1, (1 << 20) // part.width)
        with _store(self.folder)[0].open_input_file(part.path) as handle:
            for at in range(part.start, part.start + part.rows, step):
                n = min(step, part.start + part.rows - at)
                handle.seek(part.offset + at * part.width * dtype.itemsize)
                data = handle.read(n * part.width * dtype.itemsize)
                if len(data) < n * part.width * dtype.itemsize:
                    raise ValueError(f"{part.path}: cut short")
                flat = np.frombuffer(data, dtype).astype(np.float64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.width, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(at, at + n)), values], names=["path", "at", "values"])


def array_rows(spark: SparkSession, path: str, pattern: str = "*.npy", rows: int = 1 << 20) -> DataFrame:
    """``ArrayRows``; an array of many rows is read by many tasks."""
    spark.dataSource.register(ArrayRows)
    return spark.read.format("array_rows").option("path", path).option("pattern", pattern).option("rows", rows).load()


def cloud(spark: SparkSession, folder: str, rows: int = 1 << 20) -> tuple[str, DataFrame]:
    """(source, points: at, frame_index, x, y, z, confidence) of a reconstruction's folder.

    The preview where there is one (``point_cloud_preview.npz``, a zip whose
    members one task reads, as it is small by its making), else the arrays
    ``world_points.npy`` [1, frames, lines, columns, 3] and
    ``world_points_conf.npy`` [1, frames, lines, columns], of which only the
    first batch counts. Missing files and other shapes raise.
    """
    store, at = _store(folder)
    there = {f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File}
    if "point_cloud_preview.npz" in there:
        path = f"{at.rstrip('/')}/point_cloud_preview.npz"

        def members(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with _store(folder)[0].open_input_file(name) as handle, zipfile.ZipFile(io.BytesIO(handle.read())) as held:
                        points, confidence, frames = (np.load(io.BytesIO(held.read(f"{m}.npy")), allow_pickle=False) for m in ("points", "confidence", "frame_index"))
                    for k in range(0, len(points), 1 << 16):
                        own = slice(k, k + (1 << 16))
                        x, y, z = points[own].astype(np.float64).T
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(x))), pa.array(frames[own].astype(np.int64)), *map(pa.array, (x, y, z)), pa.array(confidence[own].astype(np.float64))], names=["at", "frame_index", "x", "y", "z", "confidence"])

        return "point_cloud_preview.npz", spark.createDataFrame([(path,)], "path string").mapInArrow(members, "at long, frame_index long, x double, y double, z double, confidence double")
    if not {"world_points.npy", "world_points_conf.npy"} <= there:
        raise FileNotFoundError(f"{folder}: neither a preview nor world_points and world_points_conf")
    shapes = []
    for name in ("world_points.npy", "world_points_conf.npy"):
        with store.open_input_file(f"{at.rstrip('/')}/{name}") as handle:
            shapes.append(array_header(handle)[0])
    points, confidence = shapes
    if len(points) != 5 or points[-1] != 3 or points[:4] != confidence:
        raise ValueError(f"{folder}: expected [1, frames, lines, columns, 3] and [1, frames, lines, columns], got {points} and {confidence}")
    _, frames, lines, columns, _ = points
    total = frames * lines * columns
    p = array_rows(spark, folder, "world_points.npy", rows).where(F.col("at") < total).select("at", *[F.col("values")[k].alias(c) for k, c in enumerate("xyz")])
    # The confidences' rows are lines of their own array, so they are taken apart into points.
    c = array_rows(spark, folder, "world_points_conf.npy", max(1, rows // max(columns, 1))).where(F.col("at") < frames * lines)
    c = c.select(F.col("at").alias("line"), F.posexplode("values").alias("k", "confidence")).select((F.col("line") * columns + F.col("k")).alias("at"), "confidence")
    return "world_points.npy", p.join(c, "at").select("at", F.expr(f"at div {max(lines * columns, 1)}").alias("frame_index"), "x", "y", "z", "confidence")


def load_points(scratch: Scratch, folder: str, threshold: float, most: int, rows: int = 1 << 20) -> dict:
    """What is shown of a reconstruction: ``points``, at most so many of those that are finite and sure enough, evenly by their order; ``source``, ``valid_count_in_source`` and ``source_count``."""
    source, held = cloud(scratch.spark, folder, rows)
    held = scratch.cut(held)
    valid = held.where(usable(threshold))
    return {"source": source, "points": scratch.keep(evenly_picked(scratch, valid, ["at"], most)), "valid_count_in_source": valid.count(), "source_count": held.count()}


class VideoHeaders(DataSource):
    """What the headers of video files say: path, container, fps, frame_count, width, height, duration_sec (null without a rate). Options: path, pattern."""

    @classmethod
    def name(cls) -> str:
        return "video_headers"

    def schema(self) -> str:
        return "path string, container string, fps double, frame_count long, width int, height int, duration_sec double"

    def reader(self, schema) -> DataSourceReader:
        return _VideoReader(self.options)


class _VideoReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _listed(self.folder, self.pattern)] or [InputPartition("")]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if part.value:
            with _store(self.folder)[0].open_input_file(part.value) as handle:
                try:
                    container, fps, frames, width, height = video_header(handle)
                except (ValueError, struct.error) as e:
                    raise ValueError(f"{part.value}: could not read the video's header: {e}") from e
            yield part.value, container, fps, frames, width, height, frames / fps if fps > 0 else None


def video_header(handle) -> tuple[str, float, int, int, int]:
    """(container, frames a second, frames, width, height) of an AVI or an ISO file (mp4, mov); the pictures themselves are skipped. Others raise."""
    head = handle.read(12)
    handle.seek(0)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return ("avi", *_avi(handle))
    if len(head) >= 8 and head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        return ("iso", *_iso(handle))
    raise ValueError("neither AVI nor ISO")


def _avi(handle) -> tuple[float, int, int, int]:
    """The main header and the first video stream's: chunks of a name, a length and content, filled up to even lengths; lists hold chunks."""
    main, rate = None, None
    end, todo, kind = handle.size(), [12], b""
    while todo:
        at = todo.pop()
        handle.seek(at)
        head = handle.read(8)
        if len(head) < 8 or at >= end:
            continue
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"LIST":
            form = handle.read(4)
            if form == b"movi":
                break
            todo += [at + 8 + length + length % 2, at + 12] if form in (b"hdrl", b"strl") else [at + 8 + length + length % 2]
            continue
        if name == b"avih":
            main = struct.unpack("<14I", handle.read(56))
        elif name == b"strh":
            held = handle.read(56)
            kind = held[:4]
            if kind == b"vids" and rate is None:
                scale, per, _, frames = struct.unpack("<4I", held[20:36])
                rate = (per / scale if scale else 0.0, frames)
        todo.append(at + 8 + length + length % 2)
    if main is None:
        raise ValueError("no main header")
    fps, frames = rate or (1e6 / main[0] if main[0] else 0.0, main[4])
    return fps, frames, main[8], main[9]


def _boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, first and last byte of the content) of the boxes in a stretch of bytes."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head:
            raise ValueError("a box is shorter than its head")
        yield name, at + head, min(at + size, end)
        at += size


def _inner(data: bytes, at: tuple[int, int], *names: bytes) -> tuple[int, int] | None:
    for name in names:
        at = next(((a, b) for n, a, b in _boxes(data, *at) if n == name), None)
        if at is None:
            return None
    return at


def _iso(handle) -> tuple[float, int, int, int]:
    """The first video track's header: time scale and length, number of samples, size. Only the heads of the outer boxes and the index box are read."""
    end, at, index = handle.size(), 0, None
    while at + 8 <= end and index is None:
        handle.seek(at)
        head = handle.read(16)
        size, name = struct.unpack(">I4s", head[:8])
        size = struct.unpack(">Q", head[8:16])[0] if size == 1 else size or end - at
        if size < 8:
            raise ValueError("a box is shorter than its head")
        if name == b"moov":
            handle.seek(at)
            index = handle.read(size)
        at += size
    if index is None:
        raise ValueError("no index box")
    whole = next((a, b) for n, a, b in _boxes(index) if n == b"moov")
    for name, a, b in _boxes(index, *whole):
        kind = _inner(index, (a, b), b"mdia", b"hdlr") if name == b"trak" else None
        if kind is None or index[kind[0] + 8 : kind[0] + 12] != b"vide":
            continue
        clock, track, samples = _inner(index, (a, b), b"mdia", b"mdhd"), _inner(index, (a, b), b"tkhd"), _inner(index, (a, b), b"mdia", b"minf", b"stbl", b"stsz")
        if clock is None or track is None or samples is None:
            raise ValueError("a video track lacks its headers")
        long = index[clock[0]] == 1
        scale, length = struct.unpack(">IQ" if long else ">II", index[clock[0] + (20 if long else 12) : clock[0] + (32 if long else 20)])
        frames = struct.unpack(">I", index[samples[0] + 8 : samples[0] + 12])[0]
        width, height = (v >> 16 for v in struct.unpack(">II", index[track[1] - 8 : track[1]]))
        return (frames * scale / length if length and scale else 0.0), frames, width, height
    raise ValueError("no video track")


def video_headers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``VideoHeaders`` of a file or of a folder's files, a task each; a missing path and files of other kinds raise."""
    spark.dataSource.register(VideoHeaders)
    return spark.read.format("video_headers").option("path", path).option("pattern", pattern).load()
