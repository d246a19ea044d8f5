"""Hard negatives against all pairs; brackets against distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("trackloom.llm")

from trackloom.llm import negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, d int, g int, cell int, wanted string"


def plain(rows, is_anchor, positives=5, most=10, low=30, high=90):
    known = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i in {r[0] for r in known if is_anchor(r[0])}:
        _, v, c = min((r for r in known if r[0] == i), key=lambda r: (r[1], r[2]))
        others = [(-dot(v, w), j, k) for j, w, k in known if j != i]
        for s, j, _ in sorted(o for o in others if o[2] == c)[:positives]:
            fit = sorted(o for o in others if o[2] != c and low * -s <= 100 * -o[0] <= high * -s)[:most]
            out += [(i, j, n, o[1], -s, -o[0]) for n, o in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_all_anchors_and_positives(spark, spread):
    r = random.Random(11)
    centres = [[r.gauss(0, 0.4) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + r.gauss(0, spread * 0.4) for c in centres[i % 8]], (i // 8) % 3) for i in range(-40, 600)]
    rows += [(7, None, 1), (8, [float("nan")] * 6, 1), (9, [None] + [0.0] * 5, 1), (None, [0.1] * 6, 1), (10, [0.1] * 6, None), (11, [float("inf")] * 6, 1)]
    rows += [rows[100], rows[41], (0, [0.5] * 6, 2), (100, [0.1, 0.2], 1), (700, [], 0), (650, rows[45][1], 0), (651, rows[45][1], 1), (652, rows[45][1], 1), (800, [0.0] * 6, 1)]
    frame = spark.createDataFrame([(*x, 1, 2, 3, "w") for x in rows], SCHEMA).repartition(3)
    want = plain(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, negatives.hard_negatives(spark, frame, F.col("vec_id") % 10 == 0).collect())) == want
    small = negatives.hard_negatives(spark, frame, F.col("vec_id") % 10 == 0, pivots=5, sample=40, block_rows=30, anchor_rows=20)
    assert sorted(map(tuple, small.collect())) == want
    assert len({w[0] for w in want}) > 20


def test_labels_move_and_odd_tables(spark):
    rows = [(i, [((i * 37) % 19 - 9) / 9, ((i * 53) % 23 - 11) / 11, 0.3], i % 10) for i in range(400)]
    moved = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    frame = spark.createDataFrame([(*x, 1, 2, 3, "w") for x in rows], SCHEMA)
    assert sorted(map(tuple, negatives.mined(spark, frame).collect())) == plain(moved, lambda i: i % 100 == 0)
    empty = negatives.mined(spark, spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and empty.isEmpty()
    assert negatives.mined(spark, frame.where("vec_id = 100")).isEmpty()


def test_brackets_hold_and_prune():
    r = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(r.normal(0, 1, (20, 8)), 50, axis=0) + r.normal(0, 0.02, (1000, 8))))
    m = float((x * x).sum(axis=1).max())
    pivots = negatives.spread_pivots(negatives.augmented(x[:500], m), 16)
    assert len(pivots) == 16
    q = x[::100]
    lower, upper = negatives.brackets(negatives.distances(negatives.augmented(q, 0.0), pivots), (q * q).sum(axis=1), negatives.distances(negatives.augmented(x, m), pivots), m)
    scores = q @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
    alive = upper >= np.sort(lower, axis=1)[:, [-5]]
    assert alive.mean() < 0.5  # clustered vectors: most rows go by their brackets alone
