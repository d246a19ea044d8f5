"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic text and one on ordinary
text. A document is cut into windows of one word each; a window that becomes
shorter with the toxic dictionary than with the ordinary one is evidence. How
often windows of a document gain 2, 3, 4 or 6 bytes, and how many it has, give
its score through weights fitted to learning documents that the dictionaries
had not seen.

Labels mark whole documents, most of whose words are ordinary. So the toxic
dictionary is trained on the windows that hold a byte n-gram which far more
toxic documents hold, or hold twice, and the ordinary one is trained twice:
the windows of ordinary documents that seem toxic at first go in again,
nearest the end, where references are shortest. Windows with an n-gram that
toxic documents repeat and ordinary ones don't are left out of it, as now and
then an ordinary document has one too.

A window alone is too short to be compressed at all, so a fixed line that both
dictionaries hold is put behind it. Dictionaries serve as raw content, so that
literals cost the same with both.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, text_batches, unused
from .linear import fit_logistic, sigmoid
from .pretokens import Memory, loaded

FRAME = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ "
GAINS = (2, 3, 4, 6)
THRESHOLD = 0.7
#: The part of ordinary learning documents, looked at with dictionaries trained without them, that may reach the threshold.
FALSE_MARKS = 0.004
#: Bytes of a word that a window holds; longer words are several windows.
WINDOW = 48
#: Lengths of the n-grams that are looked for in all windows, and in those that hold a telling one.
SHORT, LONG = (5, 6), (7, 8, 9)


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if all(len(w) <= WINDOW for w in words):
        return words
    return [w[k : k + WINDOW] for w in words for k in range(0, len(w), WINDOW)]


def _grams(word: bytes, sizes: tuple[int, ...] = SHORT) -> set[bytes]:
    b = b" " + word + b" "
    return {b[i : i + k] for k in sizes for i in range(len(b) - k + 1)}


def _core(word: bytes, telling: set[bytes]) -> bytes:
    """The part of a window, with a space on either side, that telling n-grams cover; empty if none does."""
    b = b" " + word + b" "
    spans = [(i, i + k) for k in SHORT + LONG for i in range(len(b) - k + 1) if b[i : i + k] in telling]
    return b[min(a for a, _ in spans) : max(z for _, z in spans)] if spans else b""


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(9, source_size=128, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4)
    d = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _trained(size: int, counts: Counter) -> bytes:
    """Dictionary content from pieces, each as often as it occurs."""
    pieces = [b" " + w + b" " for w in sorted(counts) for _ in range(counts[w])]
    random.Random(7).shuffle(pieces)
    try:
        return zstandard.train_dictionary(size, pieces, d=6, k=24).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: all of it
        return b"".join(dict.fromkeys(pieces))[-size:]


class Model:
    """The two dictionaries and the calibrated weights; what is sent to the executors."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self.memory = None

    def __getstate__(self):
        return self.__dict__ | {"memory": None}

    def _memory(self) -> Memory:
        bad, good = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        return Memory(lambda w: len(good(b" " + w + b" " + FRAME)) - len(bad(b" " + w + b" " + FRAME)), 150_000)

    def gain(self, window: bytes) -> int:
        """Bytes by which the toxic dictionary makes the window shorter."""
        if self.memory is None:
            self.memory = loaded(("gains", self.toxic, self.ordinary), self._memory)
        return self.memory[window]

    def evidence(self, text: bytes) -> list[float]:
        own = windows(text)
        gains = np.fromiter(map(self.gain, own), np.int16, len(own))
        size = float(np.log(len(own) + 20.0))
        return [float(np.log((gains >= g).sum() + 0.1)) - size + 5.0 for g in GAINS] + [size - 5.0]

    def score(self, text: bytes | None) -> float:
        x = np.array([*self.evidence(text or b""), 1.0])
        return float(sigmoid(x @ self.weights))


def _telling(toxic: Counter, ordinary: Counter, n: Counter, times: int = 20) -> set[bytes]:
    """The n-grams of enough toxic documents that are so many times as common there."""
    return {g for g, k in toxic.items() if k >= max(4, 0.03 * n[1]) and k / n[1] >= times * (ordinary[g] + 0.5) / n[0]}


def dictionaries(texts: list[tuple[bytes, int]]) -> Model:
    """Both dictionaries from texts of both classes, without weights."""
    words, once, often, n = *({1: Counter(), 0: Counter()} for _ in range(3)), Counter(y for _, y in texts)
    held = [(Counter(windows(t)), y) for t, y in texts]

    def count(sizes: tuple[int, ...], among: set[bytes] | None) -> None:
        for own, y in held:
            grams = Counter()
            for w, k in own.items():
                if among is None or _core(w, among):
                    for g in _grams(w, sizes):
                        grams[g] += k
            once[y].update(grams.keys())
            often[y].update(g for g, k in grams.items() if k > 1)

    for own, y in held:
        words[y].update(own.keys())
    count(SHORT, None)
    # Some stems are met now and then in ordinary documents, but twice in hardly any.
    repeated = _telling(often[1], often[0], n, 10)
    count(LONG, repeated)
    repeated |= {g for g in _telling(often[1], often[0], n, 10) if len(g) in LONG}
    telling, suspect = _telling(once[1], once[0], n) | repeated, Counter()
    for w, k in words[1].items():
        if core := _core(w, telling):
            suspect[core] += k
    usual = Counter({w: k for w, k in words[0].items() if not _core(w, repeated)})
    ordinary = _trained(65536, usual)
    model, again = Model(_trained(6144, suspect), ordinary), Counter()
    for _ in range(2):
        again.update({w: k + 3 for w, k in usual.items() if model.gain(w) >= 2})
        if again:
            model = Model(model.toxic, ordinary + _trained(24576, again))
    return model


def fit(sample: list[tuple[str, int]], parts: int = 3) -> Model:
    """Train both dictionaries, and calibrate: for even odds of the classes, and lower where too many ordinary documents would be marked.

    The weights are fitted to evidence that every text got from dictionaries
    trained without it: the sample is cut into ``parts``, and each is looked at
    with what the others give. With only one class in a cut, or at all, every
    score is that class's side of one half.
    """
    texts = [(t.encode(), y) for t, y in dict.fromkeys(sample)]
    random.Random(5).shuffle(texts)
    n = Counter(y for _, y in texts)
    cuts = [[r for k, r in enumerate(texts) if k % parts != part] for part in range(parts)]
    if any(len({y for _, y in cut}) < 2 for cut in cuts):
        return Model(b"", b"", np.array([0.0] * (len(GAINS) + 1) + [np.log((n[1] + 1) / (n[0] + 1))]))
    seen = []
    for part, cut in enumerate(cuts):
        other = dictionaries(cut)
        seen += [(other.evidence(t), y) for k, (t, y) in enumerate(texts) if k % parts == part]
    model = dictionaries(texts)
    model.weights = fit_logistic(np.array([e for e, _ in seen]), np.array([y for _, y in seen], float), ridge=0.05)
    # The score of ordinary documents above which only so few of them lie comes below the threshold.
    ordinary = np.sort([float(np.array([*e, 1.0]) @ model.weights) for e, y in seen if not y])
    reach = ordinary[max(0, len(ordinary) - 1 - int(FALSE_MARKS * len(ordinary)))]
    model.weights[-1] -= max(0.0, reach + 1e-6 - float(np.log(THRESHOLD / (1 - THRESHOLD))))
    return model


class _Scored:
    """Adds the score of the text column; passes on at most ``ROWS`` rows at once, so that batches of long texts don't pile up on the way back."""

    ROWS = 512

    def __init__(self, model, name: str, at: int):
        self.model, self.name, self.at = model, name, at

    def __call__(self, batches):
        for whole in batches:
            for start in range(0, whole.num_rows, self.ROWS):
                batch = whole.slice(start, self.ROWS)
                texts = batch.column(self.at).cast(pa.binary())
                scores = [self.model.score(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, self.name])


def with_score(docs: DataFrame, model) -> tuple[DataFrame, str]:
    """``docs`` and a score column, and that column's name; one pass, no shuffle, all other columns as they were."""
    name, at = unused(docs, "score"), [c.lower() for c in docs.columns].index("text")
    return text_batches(docs).mapInArrow(_Scored(model, name, at), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def trained(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500, max_bytes: int = 8 << 20) -> Model:
    """A model from at most ``max_per_class`` labelled documents, and about ``max_bytes`` of text, of each class outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", max_per_class, max_bytes)[0])


def score_documents(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Every whole text is scored; null counts as empty. Nothing but the text
    enters the score. A null id is never held out. Repeated rows are repeated;
    other columns are ignored. Without labels of both classes all scores are
    alike; an empty table has no rows.
    """
    model = trained(docs, labels, max_per_class)
    scored, _ = with_score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_per_class: int = 1500) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns, repeated rows and rows without an id stay. A null text counts as empty."""
    scored, name = with_score(docs, trained(docs, labels, max_per_class))
    return scored.where(F.col(name) < THRESHOLD).drop(name)
