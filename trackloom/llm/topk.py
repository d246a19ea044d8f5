"""Exact top-k inner products by no-random-access aggregation.

Vectors are dealt into blocks, and every block of queries meets every block of
candidates in a group of its own. Within a group each dimension has its list
of candidates sorted by value. A query reads the lists of all dimensions in
which it is not zero, in step: from the top where its component is positive,
from the bottom where it is negative. What has been read of a candidate gives
it bounds: the components not yet read count as the end of their lists for the
lower one, and as the value that the reading has reached for the upper one. A
candidate that has not been met at all can reach what the reading has reached
in all lists. A query stops when those who can still reach the k-th best lower
bound are no more than k, or are settled; only then are those few resolved to
their final scores. Many queries read the same stretch of the lists at once,
as a product of matrices, and each stops on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entries of every list that are read before the bounds are first looked at.
FIRST = 64
#: Queries that read together. Each stops on its own.
BATCH = 128
#: Candidates whose bounds tell whether a look at all of them may be worth it.
PROBE = 1024


def depths(n: int, first: int = FIRST) -> Iterator[int]:
    """How far the lists of n entries have been read at each look: four times as far each time, then half of what is left, at last all."""
    at = first
    while at < n:
        yield at
        at = at * 4 if at * 4 < n else at + (n - at) // 2 if n - at > max(2 * first, n // 8) else n
    yield n


class Lists:
    """The sorted lists of a block, from the top and from the bottom, and how many entries queries have read in all."""

    def __init__(self, block: np.ndarray, kind=np.float64):
        self.n, self.width = block.shape
        self.kind = kind  # single precision where it holds all sums of products
        up = np.argsort(block, axis=0, kind="stable").T
        self.ids = np.vstack([up[:, ::-1], up])
        self.values = np.take_along_axis(np.vstack([block.T, block.T]), self.ids, axis=1).astype(kind)
        self.read = 0

    def stretch(self, before: int, depth: int, missing: np.ndarray) -> np.ndarray:
        """The entries of all lists from ``before`` to ``depth`` as a matrix of lists by candidates; takes them out of ``missing``."""
        part, out = self.ids[:, before:depth], np.zeros(missing.shape, self.kind)
        np.put_along_axis(out, part, self.values[:, before:depth], axis=1)
        np.put_along_axis(missing, part, 0, axis=1)
        return out

    def best(self, queries: np.ndarray, k: int, out: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (candidates, score or NaN): at least the k best of those that are not ``out``, ties included; the score where the reading has settled it."""
        q = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(self.kind)
        ends, lists = q * self.values[:, -1], (q != 0).sum(axis=1)
        partial, missing = np.zeros((len(q), self.n), self.kind), np.ones(self.ids.shape, self.kind)
        found, going, before = [None] * len(q), np.arange(len(q)), 0
        for depth in depths(self.n):
            # What the queries that still read add from these entries of their lists.
            partial[going] += q[going] @ self.stretch(before, depth, missing)
            self.read += int((depth - before) * lists[going].sum())
            before = depth
            reached = q[going] * self.values[:, depth - 1]
            if depth < self.n:
                # Nobody can stop while one not met could still beat the best lower bound of some.
                some = np.s_[: min(PROBE, self.n)]
                sure = (partial[going, some] + ends[going] @ missing[:, some]).max(axis=1)
                hopeful = reached.sum(axis=1) < sure
            else:
                hopeful = np.ones(len(going), bool)
            looks = going[hopeful]
            if not len(looks):
                continue
            lower, upper = partial[looks] + ends[looks] @ missing, partial[looks] + reached[hopeful] @ missing
            for i, low, high in zip(looks, lower, upper, strict=True):
                low[out[i]] = high[out[i]] = -np.inf
                kth = np.partition(low, self.n - k)[self.n - k] if self.n > k else -np.inf
                left = np.flatnonzero((high >= kth) & ~out[i])
                known = low[left] == high[left]
                if len(left) <= k or known.all():
                    found[i] = left, np.where(known, low[left], np.nan).astype(np.float64)
            going = np.array([i for i in going if found[i] is None], np.int64)
            if not len(going):
                break
        return found


def top_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int, lists: Lists | None = None):
    """(query id, id, score) of each query's k best in the block, ties to the smaller id; a query's own id is left out."""
    if not len(block) or not len(queries):
        return
    queries, block = queries.astype(np.int64), block.astype(np.int64)
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, block.shape[1])
    if reach >= 1 << 53:  # beyond what doubles hold, all scores are taken in Python's integers
        queries, block = queries.astype(object), block.astype(object)
    else:
        lists = lists or Lists(block, np.float32 if reach < 1 << 24 else np.float64)
    for at in range(0, len(queries), BATCH):
        some = queries[at : at + BATCH]
        own = ids[None, :] == query_ids[at : at + BATCH, None]
        found = lists.best(some, k, own) if lists else [(np.flatnonzero(~o), None) for o in own]
        for query_id, query, (left, scores) in zip(query_ids[at : at + BATCH], some, found, strict=True):
            if scores is None:
                scores = block[left] @ query
            else:
                short = np.flatnonzero(np.isnan(scores))
                scores[short] = block[left[short]] @ query
                scores = np.rint(scores).astype(np.int64)
            for j in np.lexsort((ids[left], -scores))[:k]:
                yield int(query_id), int(ids[left[j]]), int(scores[j])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if width and len(flat) == width * len(rows):
        return flat.reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows.to_pylist()):
        out[k, : len(r)] = r
    return out


def _meet(k: int):
    def meet(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        width = max([0, *(len(v) for t in (queries, block) for v in t.column("v"))])
        rows = list(top_of_block(queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), width), block.column("vec_id").to_numpy(), _matrix(block.column("v"), width), k)) if width or block.num_rows else []
        columns = zip(*rows) if rows else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return meet


def quantised(vectors: DataFrame, scale: int = 64, *others: str) -> DataFrame:
    """(vec_id, v), with ``others`` as longs between them: components as floor(scale * x); without vectors that are null or hold null or non-finite components, and without null ids."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long"), *[F.col(c).cast("long") for c in others], F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 20, block_rows: int = 16_384, query_rows: int = 4_096) -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank (from 1), vec_id, score.

    Queries: rows whose vec_id is divisible by 20, or ``is_query``. Ties go to
    the smaller vec_id. A query's own id never counts; repeated rows count one
    by one; vectors of different lengths are compared as if padded with zeros.
    With fewer than k others all are returned. Rows with a null id or vector,
    or a component that is null or not finite, take no part; other columns,
    whatever their names, are ignored; an empty table gives an empty result. A
    group holds about ``block_rows`` candidates and ``query_rows`` queries,
    whatever the input.
    """
    rows = quantised(vectors)
    chosen = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    reach = F.array_max(F.transform("v", lambda c: F.abs(c)))
    n, m, most = rows.agg(F.count(F.lit(1)), F.count_if(chosen), F.max(reach)).first()
    # Every candidate goes to each group of queries and every query to each block, so they travel in 16 bits where that holds them.
    rows = rows.withColumn("v", F.col("v").cast("array<smallint>")) if (most or 0) < 1 << 15 else rows
    asks = rows.where(chosen)
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    left = asks.withColumns({"h": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"), "g": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = rows.withColumns({"g": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "h": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    met = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
