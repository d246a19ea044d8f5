"""Hard-negative mining over a table of pivot distances.

Augmentation. With M the largest squared length of a vector, a vector x gets
one more component sqrt(M - |x|^2) and an anchor q a zero. All augmented
vectors then have the squared length M, and the squared distance of q and x is
|q|^2 + M - 2 q.x: the nearer, the higher the score.

Pivots. A few augmented vectors, spread out, are pivots; every vector's
distances to them are stored beside it. By the triangle inequality
|d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for every pivot p, which
brackets the score. Vectors are dealt to blocks by their nearest pivot, and a
block's own least and largest distances bracket all its scores at once.

Search. First every anchor's best vectors of its own label: in a block, those
whose upper bracket reaches the k-th lower bracket survive, and survivors get
their exact integer scores. Then the negatives: a positive's score gives the
interval that a negative's score must lie in; blocks whose bracket misses all
intervals of an anchor are not visited by it, rows whose bracket misses the
interval or lies below the k-th lower bracket within it go, and the rest are
checked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored
from .topk import _matrix, quantised

#: Anchors whose brackets are computed at once.
STEP = 32
#: What brackets are widened by, as a part of M: a squared distance is off by some 2e-14 M in doubles, so a distance of almost nothing by 1.5e-7 sqrt(M), and the square of a difference of distances by 1.2e-6 M.
SLACK = 1e-5


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def augmented(x: np.ndarray, m: float) -> np.ndarray:
    """The vectors with the component that makes all squared lengths ``m``."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(m - (x * x).sum(axis=1), 0.0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


class _Place:
    """(vec_id, label, v) to the same with the distances to the pivots and the nearest one; ``m`` is zero for anchors."""

    def __init__(self, pivots: np.ndarray, m: float):
        self.pivots, self.m = pivots, m

    def __call__(self, batches):
        for batch in batches:
            d = distances(augmented(_matrix(pa.chunked_array([batch.column(2)]), self.pivots.shape[1] - 1), self.m), self.pivots)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, held, pa.array(d.argmin(axis=1), pa.int32())], names=["vec_id", "label", "v", "d", "cell"])


def brackets(own: np.ndarray, length: np.ndarray, others: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors (their distances to the pivots, their squared lengths) with rows of known distances."""
    near, far = np.zeros((len(own), len(others))), np.full((len(own), len(others)), np.inf)
    for p in range(own.shape[1]):
        np.maximum(near, np.abs(own[:, p, None] - others[None, :, p]), out=near)
        np.minimum(far, own[:, p, None] + others[None, :, p], out=far)
    base = (length + m)[:, None]
    return (base - far * far) / 2 - SLACK * m, (base - near * near) / 2 + SLACK * m


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] > k else np.full(len(values), -np.inf)


class _Block:
    """One group of anchors and one block of the pivot table."""

    def __init__(self, anchors: pa.Table, block: pa.Table, m: float, width: int):
        self.q, self.x = (_matrix(t.column("v"), width).astype(np.float64 if m < 2**53 else object) for t in (anchors, block))
        self.qid, self.xid = (t.column("vec_id").to_numpy() for t in (anchors, block))
        self.ql, self.xl = (t.column("label").to_numpy() for t in (anchors, block))
        self.own, self.others = (_doubles(t.column("d")) for t in (anchors, block))
        self.length, self.m = (self.q.astype(np.float64) ** 2).sum(axis=1), m

    def steps(self, label: int | None = None):
        """(numbers of some anchors, numbers of rows, lower and upper brackets): all, or those of one label."""
        asks = np.arange(len(self.q)) if label is None else np.flatnonzero(self.ql == label)
        rows = np.arange(len(self.x)) if label is None else np.flatnonzero(self.xl == label)
        for at in range(0, len(asks) if len(rows) else 0, STEP):
            part = asks[at : at + STEP]
            yield part, rows, *brackets(self.own[part], self.length[part], self.others[rows], self.m)

    def exact(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer scores. Doubles hold them while M is below 2^53, as |q.x| <= M; beyond that they are Python's integers."""
        return self.q[anchors] @ self.x[rows].T


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best, ties to the smaller id."""
    if len(scores) > k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))


def _table(rows: list[tuple], names: str) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[] for _ in names.split()])], names=names.split())


def _positives(k: int, m: float, width: int):
    def meet(key, anchors: pa.Table, block: pa.Table) -> pa.Table:
        if not anchors.num_rows or not block.num_rows:
            return _table([], "anchor_id positive_id score")
        b, out = _Block(anchors, block, m, width), []
        for label in np.unique(b.ql):
            for part, rows, lower, upper in b.steps(label):
                own = b.xid[rows][None, :] == b.qid[part, None]
                lower[own] = -np.inf
                alive = ~own & (upper >= _kth(lower, k)[:, None])
                left = np.flatnonzero(alive.any(axis=0))
                scores = b.exact(part, rows[left])
                for i, a in enumerate(part):
                    at = np.flatnonzero(alive[i, left])
                    ids = b.xid[rows[left[at]]]
                    out += [(int(b.qid[a]), int(ids[j]), int(scores[i, at[j]])) for j in _best(ids, scores[i, at], k)]
        return _table(out, "anchor_id positive_id score")

    return meet


def _negatives(k: int, low: int, high: int, m: float, width: int):
    def meet(key, anchors: pa.Table, block: pa.Table) -> pa.Table:
        if not anchors.num_rows or not block.num_rows:
            return _table([], "anchor_id place positive_id positive_score negative_id negative_score")
        b, wanted, out = _Block(anchors, block, m, width), anchors.column("wanted").to_pylist(), []
        for part, _, lower, upper in b.steps():
            differ = b.xl[None, :] != b.ql[part, None]
            asks, alive = [], np.zeros_like(differ)
            for i, a in enumerate(part):
                for w in wanted[a]:
                    least, most = low * w["score"], high * w["score"]
                    may = differ[i] & (upper[i] * 100 >= least) & (lower[i] * 100 <= most)
                    sure = may & (lower[i] * 100 >= least) & (upper[i] * 100 <= most)
                    may &= upper[i] >= _kth(np.where(sure, lower[i], -np.inf)[None, :], k)[0]
                    alive[i] |= may
                    asks.append((i, a, w, least, most, may))
            left = np.flatnonzero(alive.any(axis=0))
            scores = b.exact(part, left)
            for i, a, w, least, most, may in asks:
                at = np.flatnonzero(may[left] & (scores[i] * 100 >= least) & (scores[i] * 100 <= most))
                ids = b.xid[left[at]]
                out += [(int(b.qid[a]), w["place"], w["positive_id"], w["score"], int(ids[j]), int(scores[i, at[j]])) for j in _best(ids, scores[i, at], k)]
        return _table(out, "anchor_id place positive_id positive_score negative_id negative_score")

    return meet


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, pivots: int = 16, sample: int = 2048, block_rows: int = 16_384, anchor_rows: int = 16_384,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of the best rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's.

    ``vectors`` has vec_id, embedding and label; rows with a null id, label or
    vector, or a component that is null or not finite, take no part, and other
    columns are ignored. Anchors: ids divisible by 100, or ``anchor``. Ties go
    to the smaller id. Rows of the anchor's own id never count; of several
    rows of an anchor's id the smallest vector is the anchor, and repeated
    rows count one by one. Vectors of different lengths are compared as if
    padded with zeros. Anchors without positives, and positives without
    negatives, have no rows; nor has an empty table. The pivots come from
    ``sample`` rows, spread by the hash of the id; every row is in the pivot
    table. A group holds about ``block_rows`` rows and ``anchor_rows``
    anchors, whatever the input.
    """
    rows = quantised(vectors, scale, "label").where("label is not null")
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    n, m, width, most = rows.agg(F.count(F.lit(1)), F.max(length), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    spread = spread_pivots(augmented(_matrix(drawn.column("v"), width), m), pivots)
    rows = rows.withColumn("v", F.col("v").cast("array<smallint>")) if (most or 0) < 1 << 15 else rows
    schema = f"vec_id long, label long, v {rows.schema['v'].dataType.simpleString()}, d array<double>, cell int"
    placed = Stored(spark, rows.mapInArrow(_Place(spread, m), schema), "pivots")
    asked = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("own")).select("vec_id", "own.label", "own.v")
    # A longer table of anchors is cut into groups; the cells of the pivots are cut into blocks.
    asked = Stored(spark, asked.mapInArrow(_Place(spread, 0.0), schema).drop("cell"), "anchors")
    groups = max(1, -(-asked.df.count() // anchor_rows))
    parts, blocks = np.zeros(len(spread), np.int64), 0
    for cell, count in placed.df.groupBy("cell").count().collect():  # a row for each pivot
        parts[cell] = -(-count // block_rows)
    first, blocks = np.cumsum(parts) - parts, int(parts.sum())
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    dealt = placed.df.withColumn("g", (at(first) + F.pmod(F.xxhash64("vec_id"), at(np.maximum(parts, 1)))).cast("int"))
    shown = dealt.drop("cell").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    visits = asked.df.withColumns({"h": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"), "g": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    found = visits.groupBy("g", "h").cogroup(shown.groupBy("g", "h")).applyInArrow(_positives(positives, m, width), "anchor_id long, positive_id long, score long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))).where(F.col("place") <= positives)
    wanted = Stored(spark, ranked.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "positive_id", "score")).alias("wanted")), "wanted")

    bounds = dealt.select("g", F.posexplode("d").alias("p", "x")).groupBy("g", "p").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    bounds = bounds.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "low", "high"))), lambda b: F.struct(b.low.alias("low"), b.high.alias("high"))).alias("bounds"))
    both = F.arrays_zip("d", "bounds")
    near = F.array_max(F.transform(both, lambda z: F.greatest(z.bounds.low - z.d, z.d - z.bounds.high, F.lit(0.0))))
    far = F.array_min(F.transform(both, lambda z: z.d + z.bounds.high))
    base, slack = length + m, SLACK * m
    upper, lower = (base - near * near) / 2 + slack, (base - far * far) / 2 - slack
    reached = F.exists("wanted", lambda w: (upper * 100 >= w.score * low) & (lower * 100 <= w.score * high))
    visits = visits.join(wanted.df, F.col("vec_id") == F.col("anchor_id")).join(bounds, "g").where(reached).drop("anchor_id", "bounds")

    found = visits.groupBy("g", "h").cogroup(shown.groupBy("g", "h")).applyInArrow(_negatives(negatives, low, high, m, width), "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    result = Stored(spark, found.withColumn("rank", best).where(F.col("rank") <= negatives).select(*[c.split()[0] for c in RESULT.split(", ")]), "negatives")
    for table in (placed, asked, wanted):
        table.drop()
    return result.df


def mined(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """``hard_negatives`` after the label of every seventh id has moved on by one, modulo ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, vectors.withColumn("label", moved))
