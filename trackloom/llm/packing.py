"""Best-fit packing of token sequences, planned on the histogram of lengths.

Lengths lie between 1 and the capacity, so their histogram is small whatever
the input, and a plan over it places all documents at once:

* Lengths above a third of the capacity are matched greedily, longest first,
  each with the longest other such length that still fits; two per bin at most.
* Smaller lengths, longest first, go where the gap they leave is smallest
  (best fit), and open bins where no gap holds them.

Bins with equal gaps are handled as runs, so the work depends on the number of
different lengths and not on the number of documents. A piece finds its place
from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, id_and_text, unused
from .pretokens import MEMORY, TextEncoder, WordEndJson, grouped, loaded
from .ranking import ranked

CAPACITY = 4096


class Plan:
    """Runs of (length, first rank, bins, first bin, offset): rank r of the run goes to bin ``first + (r - rank) % bins``, one length further on in each round."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used = dict.fromkeys(counts, 0)
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit g: some bin has the gap g
        left = {n: c for n, c in counts.items() if c > 0}
        self.match_large({n: c for n, c in left.items() if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self.fit_small(n, left[n])

    def put(self, length: int, items: int, bins: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], bins, first, offset))
        self.used[length] += items

    def leave(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            self.gaps[gap].append((first, bins))
            self.open |= 1 << gap

    def match_large(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            longest = lengths[-1]
            at = bisect_right(lengths, self.capacity - longest) - 1
            other = lengths[at] if at >= 0 else None
            if other == longest and left[longest] < 2:  # one is left; it may have a shorter partner
                other = lengths[at - 1] if at >= 1 else None
            if other is None:
                bins = left[longest]
                self.put(longest, bins, bins, self.bins, 0)
                self.leave(self.capacity - longest, self.bins, bins)
                used = {longest: bins}
            else:
                bins = left[longest] // 2 if other == longest else min(left[longest], left[other])
                self.put(longest, bins, bins, self.bins, 0)
                self.put(other, bins, bins, self.bins, longest)
                self.leave(self.capacity - longest - other, self.bins, bins)
                used = {longest: 2 * bins} if other == longest else {longest: bins, other: bins}
            self.bins += bins
            for n, k in used.items():
                left[n] -= k
                if not left[n]:
                    lengths.remove(n)

    def fit_small(self, length: int, items: int) -> None:
        while items:
            fitting = self.open >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                first, bins = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.open &= ~(1 << gap)
            else:
                gap, first, bins = self.capacity, self.bins, -(-items // (self.capacity // length))
                self.bins += bins
            each = min(gap // length, items)
            full = min(bins, items // each)
            self.put(length, full * each, full, first, self.capacity - gap)
            self.leave(gap - each * length, first, full)
            self.leave(gap, first + full, bins - full)
            items -= full * each


class _Placed:
    """Adds the places; the first two columns are the length and the rank, which are not passed on."""

    def __init__(self, plan: Plan):
        runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
        self.length, self.rank, self.bins, self.first, self.offset = runs.T.copy()
        #: Ranks stay below 2 ** 48, so both fit one sorted key.
        self.keys = (self.length << 48) + self.rank

    def __call__(self, batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            run = np.searchsorted(self.keys, (length << 48) + rank, side="right") - 1
            turn, within = np.divmod(rank - self.rank[run], self.bins[run])
            places = [pa.array(self.first[run] + within), pa.array(self.offset[run] + turn * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *places], names=[*batch.schema.names[2:], "sequence_id", "offset"])


class _Pieces:
    def __init__(self, path: str, end_id: int, capacity: int, keep_ids: bool, memory: int):
        self.path, self.end_id, self.capacity, self.keep_ids, self.memory = path, end_id, capacity, keep_ids, memory

    def __call__(self, batches):
        texts = loaded(("word-end", self.path, self.memory), lambda: TextEncoder(WordEndJson(self.path), self.memory))
        step, end = self.capacity, np.array([self.end_id], np.uint32)
        for doc_ids, column in grouped(batches):
            flat, bounds = texts.batch(column)
            rows = []
            for i, doc_id in enumerate(doc_ids):
                ids = np.concatenate([flat[bounds[i] : bounds[i + 1]], end])
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step].tobytes()
                    rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part), *([part] if self.keep_ids else [])))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if self.keep_ids else {})
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``keep_ids`` also ids (little-endian, 32 bits each).

    A document is its ids and the end id; only what is longer than the
    capacity is cut. A null or empty text is the end id alone. Bytes that are
    not UTF-8 count as the replacement character; strings of special tokens in
    a text are those tokens, as the library has it.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return id_and_text(docs).mapInArrow(_Pieces(tokenizer_path, end_id, capacity, keep_ids, memory), schema)


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: their places in as few sequences as best fit finds.

    ``pieces`` must be stored (it is read three times) and needs length,
    between 1 and the capacity; all other columns stay, except that columns
    called sequence_id or offset give way to the new ones. Offsets in a
    sequence are gapless from 0.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = pieces.groupBy("length").count()
    plan = Plan({r["length"]: r["count"] for r in counts.collect()}, capacity)  # a row per length: 4096 at most
    known = spark.createDataFrame([(n, c) for n, c in plan.used.items()], "length long, count long")
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    rank = unused(pieces, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    placed = ranked(pieces, "length", order, known, rank=rank)
    return placed.select(F.col("length").alias("_0"), F.col(rank).alias("_1"), *[F.col(f"`{c}`") for c in pieces.columns]).mapInArrow(_Placed(plan), schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and rows without an id are packed like any other; other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    return pack_pieces(spark, Stored(spark, token_pieces(docs, tokenizer_path, end_id, capacity, keep_ids, memory), "pieces").df, capacity)
