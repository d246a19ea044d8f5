"""Sharding along a Hilbert curve over quantised metadata; DataFrame functions only.

Several metadata columns are quantised to a few bits each. The cells of that
grid are put in the order of the Hilbert curve through it, and the documents,
in the order of their cells, are cut into runs of equal counts. A shard then
holds few values of every dimension, so readers can skip files on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored


def hilbert_index(axes: Column, bits: int, dims: int) -> Column:
    """The index along the curve of the point whose coordinates are the array ``axes``.

    Skilling's transform: undo excess rotations from the highest bit down,
    Gray-encode, and interleave the bits, highest first.
    """
    zero = F.lit(0).cast("long")
    planes = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
    dim_steps = F.sequence(F.lit(1), F.lit(dims))

    def low(q):
        return q - 1

    def turn(state, q):
        def one(x, i):
            own, head = F.element_at(x, i), F.element_at(x, 1)
            flipped = head.bitwiseXOR(low(q))
            swap = head.bitwiseXOR(own).bitwiseAND(low(q))
            inverts = own.bitwiseAND(q) != zero
            new_head = F.when(inverts, flipped).otherwise(head.bitwiseXOR(swap))
            new_own = F.when(inverts, own).otherwise(own.bitwiseXOR(swap))
            return F.transform(x, lambda v, k: F.when(k == 0, F.when((i == 1) & ~inverts, head).otherwise(new_head)).when(k == i - 1, new_own).otherwise(v))

        return F.aggregate(dim_steps, state, one)

    rotated = F.aggregate(planes, axes.cast("array<long>"), turn)
    gray = F.aggregate(F.sequence(F.lit(2), F.lit(dims)), rotated, lambda x, i: F.transform(x, lambda v, k: F.when(k == i - 1, v.bitwiseXOR(F.element_at(x, i - 1))).otherwise(v))) if dims > 1 else rotated
    last = F.element_at(gray, dims)
    mask = F.aggregate(planes, zero, lambda t, q: F.when(last.bitwiseAND(q) != zero, t.bitwiseXOR(low(q))).otherwise(t))
    final = F.transform(gray, lambda v: v.bitwiseXOR(mask))
    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, zero, lambda acc, q: F.aggregate(final, acc, lambda a, v: a * 2 + F.when(v.bitwiseAND(q) != zero, 1).otherwise(0).cast("long")))


def codes(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, code) of every value of a categorical column: values in their order, cut into as many runs of about equal weight in rows as there are codes from 1 on; null has code 0 and no row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.withColumn("before", before).crossJoin(F.broadcast(total)).select("value", F.expr(f"int(before * {(1 << bits) - 1} div total) + 1").alias("code"))


def magnitude(value: Column, bits: int) -> Column:
    """A count as a coordinate that grows with its logarithm; null and what is below 1 are 0."""
    return F.coalesce(F.least(F.greatest(F.floor(F.log2(value.cast("double"))), F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def shards(docs: DataFrame, n_shards: int = 16, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index.

    The law is ``rows``: shard counts differ by one at most. Cells are made of
    lang, source and n_chars and ordered along the curve; within a cell
    documents go by id, then checksum and size, null ids first. size is the
    bytes of the text plus one; a null text has size 1 and the checksum of the
    empty one. Repeated rows are numbered one by one, null columns have a
    coordinate of their own, other columns are ignored; an empty table has no
    rows. The texts are read once; only their sizes and checksums go on.

    Rows are put in order by ranges, those that are wholly equal by where they
    were read, so no key fills a task. Two narrow tables stay in the shared
    folder, as the result is read from the second; some 80 bytes a document.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = Stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "lang", "source", magnitude(F.col("n_chars"), bits).alias("m")), "rows").df
    held = rows.withColumn("_read", F.monotonically_increasing_id())
    for k, c in enumerate(("lang", "source")):
        known = codes(rows, c, bits).select(F.col("value").alias(f"_v{k}"), F.col("code").alias(f"_c{k}"))
        held = held.join(known, F.col(c) == F.col(f"_v{k}"), "left")
    step = 1 << bits
    held = held.withColumn("cell", (F.coalesce("_c0", F.lit(0)) * step + F.coalesce("_c1", F.lit(0))) * step + F.col("m"))
    axes = F.array(*[F.shiftright(F.col("id").cast("int"), bits * k).bitwiseAND(step - 1) for k in (2, 1, 0)])
    # All 2 ** (3 * bits) cells, 4096 of them, whatever the input.
    curve = spark.range(1 << 3 * bits).select(F.col("id").alias("_cell"), hilbert_index(axes, bits, 3).alias("curve_index"))
    order = ["curve_index", "doc_id", "text_crc32", "size", "_read"]
    met = held.join(F.broadcast(curve), F.col("cell") == F.col("_cell")).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = Stored(spark, met.select("curve_index", "doc_id", "text_crc32", "size", F.spark_partition_id().alias("part"), within.alias("within")), "placed").df
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition of the table before.
    starts = counts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = placed.join(F.broadcast(starts), F.col("part") == F.col("_part")).withColumn("place", F.col("start") + F.col("within"))
    ranked = ranked.withColumn("shard", F.expr(f"(place * {n_shards}) div total"))
    slot = F.col("place") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")
