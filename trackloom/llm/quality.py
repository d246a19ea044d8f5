"""Quality by hashed word n-grams, logistic regression and FTRL updates.

Words are runs of letters and digits, lower-cased, and runs of other visible
characters. A word equal to the one before it is
replaced by one fixed mark. Unigrams and bigrams of these are hashed into a
fixed number of columns; a text is its count vector scaled to length one. The
weights are learned by follow-the-regularised-leader with per-coordinate rates
and L1, so most are zero; scoring is one sparse dot product per text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample
from .linear import shift, sigmoid
from .pretokens import Memory, loaded
from .toxicity import with_score

COLUMNS = 1 << 18
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REPEAT = np.uint64(xxhash.xxh64_intdigest(b"\x00repeat"))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(piece: bytes) -> bytes:
    words = WORD.findall(piece.decode("utf-8", "replace").lower())
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64).tobytes()


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns (ascending, distinct) and values of a text."""
    pieces = loaded(("word-hashes",), lambda: Memory(_hashes, 150_000))
    words = np.frombuffer(b"".join([pieces[p] for p in (text or b"").split()]), np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    marked = words.copy()
    marked[1:][words[1:] == words[:-1]] = REPEAT
    pairs = (marked[:-1] * MIX) ^ (marked[1:] + (marked[:-1] >> np.uint64(29)))
    columns, counts = np.unique(np.concatenate([marked, pairs]) % np.uint64(COLUMNS), return_counts=True)
    return columns.astype(np.int64), counts / np.sqrt(np.dot(counts.astype(float), counts.astype(float)))


class Model:
    """Non-zero weights by column, and the bias."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: float):
        self.columns, self.weights, self.bias, self.dense = columns, weights, bias, None

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def score(self, text: bytes | None) -> float:
        if self.dense is None:
            self.dense = np.zeros(COLUMNS)
            self.dense[self.columns] = self.weights
        columns, values = features(text)
        return float(sigmoid(self.dense[columns] @ values + self.bias))


def fit(sample: list[tuple[str, int]], prior: float | None = None, rounds: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """FTRL-proximal over the sample, in an order drawn with a fixed seed; classes weigh the same, and ``prior`` (the share of good documents, the sample's own by default) moves the bias."""
    rows = [(*features(t.encode()), y) for t, y in dict.fromkeys(sample)]
    share = np.mean([y for *_, y in rows]) if rows else 0.5
    weight = {1: 0.5 / max(share, 1e-9), 0: 0.5 / max(1 - share, 1e-9)}
    z, n = np.zeros(COLUMNS + 1), np.zeros(COLUMNS + 1)

    def current(at, l1):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            columns, values, y = rows[k]
            at, x = np.append(columns, COLUMNS), np.append(values, 1.0)
            w = np.append(current(columns, l1), current(np.array([COLUMNS]), 0.0))
            g = weight[y] * (sigmoid(w @ x) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = current(np.arange(COLUMNS), l1)
    used = np.nonzero(w)[0]
    own = (sum(y for *_, y in rows) + 0.5) / (len(rows) + 1)
    return Model(used, w[used], float(current(np.array([COLUMNS]), 0.0)[0]) + shift(own if prior is None else prior))


def trained(docs: DataFrame, labels: DataFrame, max_per_class: int = 2500, max_bytes: int = 12 << 20) -> Model:
    """A model from at most ``max_per_class`` labelled documents, and about ``max_bytes`` of text, of each class outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "quality", max_per_class, max_bytes))


def score_documents(docs: DataFrame, labels: DataFrame, max_per_class: int = 2500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Every whole text is scored; null counts as empty. Nothing but the text
    enters the score. A null id is never held out. Repeated rows are repeated;
    other columns are ignored. Without labels all scores are one half; an
    empty table has no rows.
    """
    scored, _ = with_score(docs.select(F.col("doc_id").cast("long"), "text"), trained(docs, labels, max_per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_per_class: int = 2500) -> DataFrame:
    """``docs`` without the documents predicted to be of low quality; all columns, repeated rows and rows without an id stay. A null text counts as empty."""
    scored, name = with_score(docs, trained(docs, labels, max_per_class))
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
