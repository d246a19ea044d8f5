"""Fill-in-middle against a plain version over code points."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("trackloom.llm")

from trackloom.llm import infill  # noqa: E402

SCHEMA = "doc_id long, text string, n long, form string, output string, back int"


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_rank_and_select():
    r = random.Random(5)
    text = "".join(r.choice("aé数🙂\n") for _ in range(9_000))
    data = np.frombuffer(text.encode(), np.uint8)
    bits = infill.Boundaries(data)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    assert (bits.select(np.arange(len(starts))) == starts).all()
    at = np.arange(len(data) + 1)
    assert (bits.rank(at) == np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])).all()
    for size in (0, 1, 63, 64, 65, 511, 512, 513):
        few = infill.Boundaries(np.full(size, 97, np.uint8))
        assert few.rank(np.array([size])).tolist() == [size]
        assert few.select(np.arange(size)).tolist() == list(range(size))


def test_transform_and_restore(spark):
    r = random.Random(7)
    letters = ["a", "é", "数", "🙂", "́", "\n", "<", "P>", "<S", " ", "\x00"]
    texts = [None, "", "a", "🙂", "<P>", "a<M>b", "<S", "x" * 200_000 + "é" * 3, *("".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (8, "another text of one id"), (9, texts[9]), (-5, "below zero")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], SCHEMA).repartition(3)
    out = infill.transform(docs)
    got = out.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda v: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in v)
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(g) for g in got), key=key) == want
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    short = infill.digests(docs).collect()
    assert sorted(g.restored_sha256 for g in short) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(g.output_sha256 for g in short) == sorted(hashlib.sha256(w[5].encode()).hexdigest() for w in want)
    assert infill.digests(spark.createDataFrame([], SCHEMA)).count() == 0
