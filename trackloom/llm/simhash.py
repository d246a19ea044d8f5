"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is set when it is set in more than half of the XXH64
hashes of the text's word shingles. Two texts are linked when their
fingerprints differ in at most three bits.

Search. Two fingerprints within three bits meet half-way: every fingerprint
emits itself and all variants of one flip, and those of even parity also
variants of two flips, as of two fingerprints at a distance of three one is
even. Equal variants meet in a bucket, which holds 65 + 2016 fingerprints at
most. Everything that meets at a variant which somebody reaches by one flip is
within three bits of that somebody, so a link to the smallest such member
loses no connection, and no bucket is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, text_batches
from .components import components

RADIUS = 3


def shingle_hashes(text: bytes | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles in UTF-8, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in pieces), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text in UTF-8; zero where there are no words."""
    return majority(shingle_hashes(text, shingle, seed))


class _Fingerprints:
    def __init__(self, shingle: int, seed: int):
        self.shingle, self.seed = shingle, seed

    def __call__(self, batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), self.shingle, self.seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_Fingerprints(shingle, seed), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _flip(bit: str) -> Column:
    return F.when(F.col(bit) < 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, {bit})"))


def _ball_variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every variant within half the radius, rounded up for fingerprints of even parity.

    Of two fingerprints at a distance of 3 one has even parity; two of its
    three differing bits lie in one half of the 64, so pairs of flips within a
    half are enough.
    """
    near = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select(F.col("fp").bitwiseXOR(_flip("i")).alias("key"), "fp")
    even = fps.where(F.bit_count("fp") % 2 == 0).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("i % 32 < 31")
    pairs = even.select("fp", "i", F.explode(F.expr("sequence(i + 1, cast((i div 32) * 32 + 31 as int))")).alias("j"))
    return near.unionAll(pairs.select(F.col("fp").bitwiseXOR(_flip("i")).bitwiseXOR(_flip("j")).alias("key"), "fp"))


def near_links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``RADIUS`` bits; ``fps`` has distinct longs fp.

    Variants are dealt by their upper half, which all flips in the lower half
    leave as it is: those rows of a fingerprint stay together and compress
    well, however many partitions there are.
    """
    w = Window.partitionBy("upper", "key")
    near = F.bit_count(F.col("key").bitwiseXOR(F.col("fp"))) <= 1
    dealt = _ball_variants(fps).withColumn("upper", F.shiftright("key", 32)).repartition("upper")
    met = dealt.withColumn("centre", F.min(F.when(near, F.col("fp"))).over(w)).where("centre is not null and centre <> fp")
    return met.where(_close("fp", "centre")).select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable through links, the row's own
    included. A null text counts as empty; texts without words have the
    fingerprint zero and are linked like any other. Repeated rows are repeated
    in the result; null ids take part but never name a component unless all of
    it is null. Other columns of ``docs`` are ignored; an empty table gives an
    empty result; texts are taken whole, however long. Two tables, of
    fingerprints and of their components, stay in the shared folder, as the
    result is read from them; some 60 bytes a document.
    """
    rows = Stored(spark, fingerprints(docs, shingle, seed), "fingerprints").df
    distinct = Stored(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(spark, near_links(spark, distinct.df.select("fp")))
    named = found.df.join(distinct.df, found.df.node == distinct.df.fp).select("node", "label", "rep")
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    moved = Stored(spark, named.select("node", "label").join(smallest, "label").select(F.col("node").alias("fp"), "least"), "moved")
    owner = Stored(spark, distinct.df.join(moved.df, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("least", "rep").alias("component_id")), "owners").df
    for done in (distinct, found, moved):
        done.drop()
    return rows.join(owner, rows.fp == owner.key).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
