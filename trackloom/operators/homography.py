"""Fitting a homography from point pairs, as sums that combine before their shuffle.

The fit minimises the algebraic error over all pairs with the last cell fixed
at one. Its normal equations need 8 x 8 sums of products per keyframe, which
the JVM adds up whatever the number of pairs; only these sums reach Python,
one row per keyframe, where the small system is solved. Pairs are shifted and
scaled to their mean and spread first, so that the sums stay well conditioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 4


def _solved(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples(index=False):
        s = np.array(r.sums, float)
        a, b = np.zeros((8, 8)), np.array(s[36:44])
        a[np.triu_indices(8)] = s[:36]
        a = a + np.triu(a, 1).T
        h = np.append(np.linalg.lstsq(a, b, rcond=None)[0], 1.0).reshape(3, 3)
        into = np.array([[1 / r.sx, 0, -r.mx / r.sx], [0, 1 / r.sy, -r.my / r.sy], [0, 0, 1]])
        back = np.array([[r.su, 0, r.mu], [0, r.sv, r.mv], [0, 0, 1]])
        m = back @ h @ into
        out.append((*[getattr(r, k) for k in keys], int(r.points), (m / m[2, 2]).ravel().tolist()))
    return pd.DataFrame(out, columns=[*keys, "points", "matrix"])


def fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points, matrix of nine cells) per keyframe out of pairs (x, y) to (u, v).

    Pairs with a null or non-finite number are left out. Keyframes with fewer
    than four pairs have no row; ask ``point_errors`` for the reasons.
    """
    known = pairs.select(*keys, *[F.col(c).cast("double") for c in "xyuv"])
    for c in "xyuv":
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    spread = lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-9))
    scale = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), *[F.avg(c).alias("m" + c) for c in "xyuv"], *[spread(c).alias("s" + c) for c in "xyuv"]).where(F.col("points") >= LEAST)
    n = known.join(scale, keys).select(*keys, *[((F.col(c) - F.col("m" + c)) / F.col("s" + c)).alias(c) for c in "xyuv"])
    x, y, u, v, zero, one = *(F.col(c) for c in "xyuv"), F.lit(0.0), F.lit(1.0)
    rows = [([x, y, one, zero, zero, zero, -u * x, -u * y], u), ([zero, zero, zero, x, y, one, -v * x, -v * y], v)]
    sums = [F.sum(rows[0][0][i] * rows[0][0][j] + rows[1][0][i] * rows[1][0][j]) for i in range(8) for j in range(i, 8)]
    sums += [F.sum(rows[0][0][i] * rows[0][1] + rows[1][0][i] * rows[1][1]) for i in range(8)]
    added = n.groupBy(*keys).agg(F.array(*sums).alias("sums")).join(scale, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*keys).schema) + ", points long, matrix array<double>"
    return added.mapInPandas(lambda parts: (_solved(p, keys) for p in parts), schema)
