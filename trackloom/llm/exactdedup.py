"""Exact duplicates: texts owned by the terminals of compressed radix tries.

Texts are compared by their full bytes after lower-casing A-Z. Each task first
puts its own texts into a trie and passes on one row per distinct text, so a
text with many copies crosses the shuffle once per task at most. The rows are
dealt by length and content hash, sorted by both, and inserted into tries over
(length, hash, bytes), whose terminals hold the id that stays and the number
of copies. As the rows come in key order, everything left of the current
(length, hash) is finished; when the trie holds more than its budget, those
subtrees are emitted and let go. Memory is bounded by the budget, the texts of
one batch and a few copies of one text.

The terminals' answers go back to the documents by the SHA-256 of the text. A
trie raises if two different texts of one hash bucket share a digest.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, text_batches, unused
from .pretokens import forget

HEAD = struct.Struct(">QQ")


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` equal those of ``b`` from ``at`` on; halving, so long runs are compared as blocks."""
    lo, hi = 0, min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.value = edge, {}, None


class Trie:
    """A Patricia trie from byte strings to (id that stays, copies)."""

    def __init__(self):
        self.root, self.held = Node(b""), 200

    def insert(self, key: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.edge) + 200
                node, at = child, len(key)
                break
            same = len(child.edge) if key.startswith(child.edge, at) else _shared(child.edge, key, at)
            if same < len(child.edge):
                upper = Node(child.edge[:same])
                child.edge = child.edge[same:]
                upper.children[child.edge[0]] = child
                node.children[key[at]] = upper
                self.held += 200
                child = upper
            node, at = child, at + same
        if node.value is None:
            node.value = (owner, copies)
        else:
            known, n = node.value
            node.value = (known if owner is None else owner if known is None else max(known, owner), n + copies)

    def take(self, before: bytes | None = None):
        """Remove and yield (key, (owner, copies)); with ``before`` only what lies left of that key's path.

        The path to the node at hand is one buffer that grows and shrinks, so
        besides the trie only one key is held.
        """
        path = bytearray()
        # (node, length of the path above it, whether the path to it is a beginning of ``before``)
        stack = [(self.root, 0, True)]
        while stack:
            node, above, on_path = stack.pop()
            del path[above:]
            path += node.edge
            if before is None or not on_path:
                if node is not self.root:
                    self.held -= len(node.edge) + 200
                if node.value is not None:
                    yield bytes(path), node.value
                    node.value = None
            at = len(path)
            for first in sorted(node.children, reverse=True):
                child = node.children[first]
                if before is None or not on_path:
                    stack.append((child, at, False))
                    del node.children[first]
                    continue
                facing = before[at : at + len(child.edge)]
                if child.edge[: len(facing)] < facing or not facing and child.edge < facing:
                    stack.append((child, at, False))
                    del node.children[first]
                elif child.edge == facing:
                    stack.append((child, at, True))


ROW = pa.schema([("text_len", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
CLASS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _batches(rows, schema: pa.Schema, size: int = 16 << 20, weigh=lambda r: 64):
    held, at = [], 0
    for r in rows:
        held.append(r)
        at += weigh(r)
        if at >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, at = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


class _LocalOwners:
    """Per task: one row per distinct text, or several when the budget empties the trie in between."""

    def __init__(self, budget: int):
        self.budget = budget

    def rows(self, batches):
        trie = Trie()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(normalised(text.as_py()), doc_id, 1)
                if trie.held > self.budget:
                    yield from self.emptied(trie)
                    trie = Trie()
        yield from self.emptied(trie)

    @staticmethod
    def emptied(trie):
        for body, (owner, copies) in trie.take():
            yield len(body), xxhash.xxh64_intdigest(body) >> 1, body, owner, copies

    def __call__(self, batches):
        forget()
        return _batches(self.rows(batches), ROW, weigh=lambda r: r[0] + 64)


class _TrieOwners:
    """Over rows in order of length and hash: the classes."""

    def __init__(self, budget: int):
        self.budget = budget

    def rows(self, batches):
        trie = Trie()
        for batch in batches:
            for n, h, body, owner, copies in zip(*(batch.column(k) for k in range(5)), strict=True):
                head = HEAD.pack(n.as_py(), h.as_py())
                if trie.held > self.budget:
                    yield from self.classes(trie.take(head))
                trie.insert(head + body.as_py(), owner.as_py(), copies.as_py())
        yield from self.classes(trie.take())

    @staticmethod
    def classes(terminals):
        bucket, digests = None, set()
        for key, (owner, copies) in terminals:
            digest = hashlib.sha256(memoryview(key)[HEAD.size :]).digest()
            if key[: HEAD.size] != bucket:
                bucket, digests = key[: HEAD.size], set()
            if digest in digests:
                raise ValueError("two different texts share a SHA-256 digest")
            digests.add(digest)
            yield digest, owner, copies

    def __call__(self, batches):
        return _batches(self.rows(batches), CLASS)


class _Digests:
    def __call__(self, batches):
        for batch in batches:
            digests = [hashlib.sha256(normalised(t.as_py())).digest() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["doc_id", "sha"])


def text_classes(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct text. ``budget``: bytes that a trie may hold."""
    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_LocalOwners(budget), "text_len long, content_hash long, body binary, owner long, copies long")
    dealt = rows.repartition("text_len", "content_hash").sortWithinPartitions("text_len", "content_hash")
    return dealt.mapInArrow(_TrieOwners(budget), "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. keep_id is the largest id of the group; null ids lose against any
    other. A repeated row (same id, same text) is the same document and is kept
    or dropped with it. Other columns of ``docs``, whatever their names, are
    ignored; an empty table gives an empty result. Texts are taken whole: a
    trie hands on what is finished when its budget is reached.
    """
    own = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_Digests(), "doc_id long, sha binary")
    found = own.join(text_classes(docs, budget), F.col("sha") == F.col("digest"), "left")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows without an id stay only where their whole group has none. Repeats of
    a kept row are reduced to one. A row is told by id and text, so losing
    with one text does not touch another text of the same id. An empty table
    stays empty; columns may have any names.
    """
    same, raw, sha = unused(docs, "same"), unused(docs, "raw"), unused(docs, "sha")
    digest = lambda: F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    rows = text_batches(docs).select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("raw")).alias("row"), F.col("text").cast("binary"))
    own = rows.mapInArrow(_Digests(), "doc_id struct<doc_id: long, raw: string>, sha binary").select("doc_id.doc_id", "doc_id.raw", "sha")
    found = own.join(text_classes(docs), F.col("sha") == F.col("digest"))
    marks = Stored(spark, found.select(F.col("doc_id").alias(same), F.col("raw").alias(raw), F.col("sha").alias(sha), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "exact").df
    its = lambda df: docs["doc_id"].eqNullSafe(df[same]) & (digest() == df[raw])
    gone = marks.where("not kept").select(same, raw).distinct()
    rest = docs.join(gone, its(gone), "left_anti")
    kept = marks.where("kept")
    often = kept.groupBy(sha).count().where("count > 1").select(sha)
    repeated = Stored(spark, kept.join(often, sha).select(same, raw, sha).distinct(), "repeated").df
    if repeated.isEmpty():
        return rest
    twice = rest.join(repeated, its(repeated)).dropDuplicates([sha]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return rest.join(repeated, its(repeated), "left_anti").unionAll(twice)
