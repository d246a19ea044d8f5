"""Token ids in files of independent zstandard frames with a seek table.

A file is one zstandard frame per document (with a content checksum), then a
skippable frame with the documents' ids, then a skippable frame with the seek
table: per frame its compressed size, its size, and the low 32 bits of the
XXH64 of its content. Readers take the table from the end of the file and
decompress only the frames they want. Ids are stored in 16 bits where the
largest id of the vocabulary allows it, else in 32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, new_path
from .pretokens import ByteLevelJson, TextEncoder, grouped, loaded

#: Fixed values of the zstandard formats: skippable frame for the ids and for the seek table, and the table's closing mark.
IDS_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1")])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, path: str, width: int, level: int = 3):
        store, at = opened(path)
        self.out, self.width = store.open_output_stream(at, compression=None), width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.documents, self.tokens = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """One document; an id that the file's width can't hold is an error."""
        if self.width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError(f"id {int(ids.max())} needs more than 16 bits")
        body = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        frame = self.zstd.compress(body)
        self.out.write(frame)
        self.entries.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.documents.append((doc_id or 0, doc_id is not None))
        self.tokens += len(ids)

    def close(self) -> None:
        named = np.array(self.documents, DOCUMENT).tobytes() + bytes([self.width])
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", IDS_MAGIC, len(named)) + named + struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        store, at = opened(path)
        self.file = store.open_input_file(at)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != END_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        table = end - 9 - n * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, n * ENTRY.itemsize), ENTRY)
        named = n * DOCUMENT.itemsize
        body = self._at(table - 8 - named - 1, named + 1)
        self.documents, self.width = np.frombuffer(body[:-1], DOCUMENT), body[-1]
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, k: int) -> int | None:
        return int(self.documents[k]["id"]) if self.documents[k]["known"] else None

    def ids(self, k: int, frame: bytes | None = None) -> np.ndarray:
        """The ids of document ``k``; raises if its checksum doesn't hold."""
        packed, size, check = self.entries[k].tolist()
        body = self.zstd.decompress(self._at(int(self.starts[k]), packed) if frame is None else frame, max_output_size=size)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError("a frame's checksum doesn't hold")
        return np.frombuffer(body, "<u2" if self.width == 2 else "<u4")

    def scan(self, block: int = 4 << 20):
        """(k, ids) of all documents in order, reading a few MB at a time."""
        k = 0
        while k < len(self):
            last = max(int(np.searchsorted(self.starts, self.starts[k] + block, side="right")) - 1, k + 1)
            held = self._at(int(self.starts[k]), int(self.starts[last] - self.starts[k]))
            for j in range(k, last):
                lo = int(self.starts[j] - self.starts[k])
                yield j, self.ids(j, held[lo : lo + int(self.entries[j]["packed"])])
            k = last


def width_for(largest: int) -> int:
    """Bytes that an id needs: 2 or 4."""
    return 2 if largest <= 0xFFFF else 4


class _Write:
    """One file per partition. Its name is new for each attempt, and only what the attempt that counted reports is ever read."""

    def __init__(self, folder: str, tokenizer_path: str, pattern: str, end_id: int):
        self.folder, self.tokenizer_path, self.pattern, self.end_id = folder, tokenizer_path, pattern, end_id

    def __call__(self, batches):
        texts = loaded(("byte-level", self.tokenizer_path), lambda: TextEncoder(ByteLevelJson(self.tokenizer_path, self.pattern)))
        out, part, end = None, TaskContext.get().partitionId(), np.array([self.end_id], np.uint32)
        for doc_ids, column in grouped(batches):
            ids, bounds = texts.batch(column)
            for k, doc_id in enumerate(doc_ids):
                if out is None:
                    path = f"{self.folder}/tokens-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
                    out = FileWriter(path, width_for(max(texts.piece.largest(), self.end_id)))
                out.add(doc_id, np.concatenate([ids[bounds[k] : bounds[k + 1]], end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(out.entries)], pa.int64()), pa.array([out.tokens], pa.int64())], names=["part", "path", "documents", "tokens"])


class _Read:
    def __init__(self, keep_ids: bool):
        self.keep_ids = keep_ids

    def __call__(self, batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows, held = FileReader(path), [], 0
                for k, ids in reader.scan():
                    body = ids.astype("<u4").tobytes()
                    rows.append((reader.doc_id(k), start, len(ids), zlib.crc32(body), *([body] if self.keep_ids else [])))
                    start, held = start + len(ids), held + 64 + self.keep_ids * len(body)
                    if held > 1 << 22:
                        yield self.batch(rows)
                        rows, held = [], 0
                if rows:
                    yield self.batch(rows)

    def batch(self, rows):
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if self.keep_ids else [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], names=[n for n, _ in kinds])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Write the ids of all documents in ascending order of their id; returns (part, path, documents, tokens) of every file.

    The texts are dealt by ranges of doc_id and encoded where they are written,
    so ids never cross a shuffle. Rows of one id (null ids, which come first,
    or repeats) are dealt by where they were read, so they may fill many files.
    ``folder`` is a URI that all executors can write to. The list has one entry
    per file.
    """
    order = ["doc_id", "_read"]
    dealt = id_and_text(docs).withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = dealt.mapInArrow(_Write(folder, tokenizer_path, pattern, end_id), "part long, path string, documents long, tokens long").collect()
    return sorted((r.part, r.path, r.documents, r.tokens) for r in files)


def read_tokens(spark: SparkSession, files: list[tuple[int, str, int, int]], keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with ``keep_ids`` also ids (little-endian, 32 bits each), read from the files."""
    rows, start = [], 0
    for _, path, _, tokens in files:
        rows.append((path, start))
        start += tokens
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_Read(keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Write all documents to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; bytes that are not UTF-8 count
    as the replacement character. Strings of special tokens in a text are those
    tokens, as the library has it. Repeated rows are written one after the
    other; other columns of ``docs`` are ignored; an empty table writes no file
    and gives no rows. The files stay in the shared folder: the result is read
    from them.
    """
    folder = new_path(spark, "tokens")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return read_tokens(spark, write_tokens(docs, folder, tokenizer_path, pattern, end_id))
