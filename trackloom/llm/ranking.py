"""Ranks within groups of any size, without any group in one task.

A group is cut into hash buckets so that a bucket holds about as many rows as
asked for. Counts per bucket give each bucket its start; only rows within a
bucket are sorted together. The table of starts has at most ``MOST`` rows plus
one per group, whatever the input, so it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused

#: Buckets in all, besides one per group; with more rows the buckets grow.
MOST = 65_536


def ranked(rows: DataFrame, group: str, order: list[str], groups: DataFrame, rows_per_bucket: int = 256, rank: str = "rank") -> DataFrame:
    """``rows`` with the column ``rank``: a number from 0 within each group, gapless.

    ``groups`` has (group, count) of all groups, is small (its size must not
    grow with the input) and is what ``rows`` really holds. Rows are dealt to
    buckets by ``order``, and rows equal in it by where they were read, as any
    numbering of those is as good: a row that is repeated very often, such as
    an empty text without an id, still fills many buckets. ``rows`` must be
    stored. Null groups form one group; all columns of ``rows`` stay.
    """
    total = groups.agg(F.sum("count").alias("total")).first()["total"] or 0
    size = max(rows_per_bucket, -(-total // MOST))
    g, n, b, h, start, within = (unused(rows, c) for c in ("_g", "_n", "_b", "_h", "_start", "_within"))
    cut = F.broadcast(groups.select(F.col(group).alias(g), F.ceil(F.col("count") / size).cast("int").alias(n)))
    part = F.floor(F.monotonically_increasing_id() / size)
    held = rows.withColumn(within, part).join(cut, F.col(group).eqNullSafe(F.col(g))).withColumn(b, F.pmod(F.xxhash64(*order, F.col(within)), F.col(n))).drop(n, within)
    counts = held.groupBy(g, b).agg(F.count(F.lit(1)).alias(start))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(g).alias(h), F.col(b).alias(n), F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    numbered = held.withColumn(within, F.row_number().over(Window.partitionBy(g, b).orderBy(*order)) - 1)
    met = numbered.join(F.broadcast(starts), F.col(g).eqNullSafe(F.col(h)) & (F.col(b) == F.col(n)))
    return met.withColumn(rank, F.col(start) + F.col(within)).drop(g, b, h, n, start, within)
