"""The prefix-tree join against plain sets."""

import random

import numpy as np
import pytest

pytest.importorskip("trackloom.llm")

from trackloom.llm import setjoin  # noqa: E402
from trackloom.llm.prefixtree import PrefixTree  # noqa: E402

SCHEMA = "doc_id long, text string, node long, size int, key long, mark long, component_id int, owner int"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min([v for v in (least.get(g), i) if v is not None], default=None)
    return [(i, len(s), least[g]) for g, (i, _), s in zip(group, rows, sets, strict=True)]


def ordered(rows):
    return sorted(((i is None, i or 0, n, c is None, c or 0) for i, n, c in rows))


def edited(r, words, share):
    out = list(words)
    for k in r.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"new{r.randrange(10**6)}"
    return out


def corpus(seed):
    """Chains and clusters around the bound, a passage that many texts share, short and odd texts."""
    r = random.Random(seed)
    passage = [f"common{k}" for k in range(30)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two three four", "One Two Three Four", "a b c d e", "a b c d e f", "\x1c a b c d", "é É x y z q", "é É x y z q"]
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([12, 40, 150, 700]))]
        texts += [" ".join(base)] * 2
        for _ in range(r.choice([1, 3, 12])):
            base = edited(r, base, r.choice([0.004, 0.01, 0.02, 0.03, 0.05])) if r.random() < 0.8 else base + passage
            texts.append(" ".join(base))
    texts += [" ".join(passage + [f"own{k}", f"own{k + 1}"] * r.choice([1, 2, 10])) for k in range(40)]
    texts += [" ".join(passage[: 20 + k]) for k in range(11)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + [rows[3], (None, texts[-1]), (None, None), (None, "no id and no copy at all here"), (-7, texts[20])]


def test_tree_finds_all_similar_sets():
    r = random.Random(1)
    for _ in range(200):
        bases = [sorted(r.sample(range(900), r.choice([0, 3, 30, 400]))) for _ in range(3)]
        sets = set()
        for _ in range(30):
            own = set(r.choice(bases))
            own ^= set(r.sample(range(900), r.choice([0, 1, 4, len(own) // 8])))
            sets.add(tuple(sorted(own)))
        sets = sorted(sets, key=lambda s: (len(s) * 31 % 17, s))
        probe = r.choice(sets)
        got = PrefixTree([np.array(s, np.uint64) for s in sets]).similar(np.array(probe, np.uint64))
        assert sorted(got) == [i for i, s in enumerate(sets) if probe and 9 * len(set(s) & set(probe)) >= 4 * (len(s) + len(probe))]
    assert PrefixTree([]).similar(np.array([1], np.uint64)) == []


def test_sketches_fold():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 2**63, 1100, dtype=np.uint64))
    b = np.union1d(a[150:], r.integers(0, 2**63, 60, dtype=np.uint64))
    x, y = setjoin.parities(a), setjoin.parities(b[:1000])
    assert len(x) == 2 * len(y) == 32
    folded = x[:16] ^ x[16:]
    bits = lambda v: np.unpackbits(v.view(np.uint8))
    assert (bits(folded) ^ bits(y)).sum() <= len(np.setxor1d(a, b[:1000]))


def test_stars_over_any_batches():
    import pyarrow as pa

    r = random.Random(4)
    rows = sorted({(r.randrange(30), r.choice([0, 0, 0, 1, 2]) if k % 2 else 0, r.randrange(1000)) for k in range(150)})
    want = []
    for key, salt, node in rows:
        own = [x[2] for x in rows if x[:2] == (key, salt)]
        if len(own) > 1 or salt:
            want.append((key, salt, node, own[0]))
    for step in (1, 2, 3, 7, 1000):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*x, 9, 1) for x in rows[at : at + step]], strict=True), (pa.int64(), pa.int16(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "salt", "node", "size", "at"])
            for at in range(0, len(rows), step)
        ]
        got = [tuple(x[c] for c in ("key", "salt", "node", "lead")) for b in setjoin._Stars()(iter(batches)) for x in b.to_pylist()]
        assert got == want


@pytest.mark.parametrize(("seed", "part_rows"), [(1, 200_000), (2, 40)])
def test_groups(spark, monkeypatch, seed, part_rows):
    monkeypatch.setattr(setjoin, "PART_ROWS", part_rows)
    monkeypatch.setattr(setjoin, "TREE", 128 if seed == 1 else 3)
    if seed == 2:
        monkeypatch.setattr(setjoin, "SAMPLE", 2)  # the sample then sees the passage, so its keys are salted
        monkeypatch.setattr(setjoin, "MARKS", 5)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6) for x in rows], SCHEMA).repartition(3)
    got = setjoin.jaccard_groups(spark, docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert ordered(map(tuple, got.collect())) == ordered(plain(rows))
    assert len({c for _, _, c in plain(rows)}) < len(rows) - 20


def test_odd_tables(spark):
    assert setjoin.jaccard_groups(spark, spark.createDataFrame([], SCHEMA)).isEmpty()
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " "), (3, " ")], "doc_id long, text string")
    assert ordered(map(tuple, setjoin.jaccard_groups(spark, blank).collect())) == ordered([(1, 0, 1), (2, 0, 2), (3, 0, 3), (3, 0, 3)])
    order = setjoin.CommonOrder(np.array([5, 3], np.uint64), np.array([2, 9]))
    assert order(np.array([1, 3, 5, 8], np.uint64))[0].tolist() == [1, 8, 5, 3]


def test_a_loose_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text, most of them too far from each other: their keys are shared, so all pairs of them meet."""
    r, made = random.Random(7), []
    monkeypatch.setattr(setjoin, "MANY", 8)
    plainly = setjoin._Join.outsiders

    def counted(*args):
        made.append(plainly(*args).count())
        return plainly(*args)

    monkeypatch.setattr(setjoin._Join, "outsiders", counted)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(r, base, r.choice([0.01, 0.02, 0.02, 0.02, 0.03])))) for k in range(120)]
    want = plain(rows)
    got = setjoin.jaccard_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(map(tuple, got.collect())) == ordered(want)
    assert 1 < len({c for _, _, c in want}) and sum(made) < 10 * len(rows)


def test_keys_of_few_sets_carry_no_sketches(spark, monkeypatch):
    """Texts that share long passages by threes and are too far from each other to be linked: many keys, few pairs."""
    made = []
    plainly = setjoin._Join.kept

    def counted(join, df, label):
        table = plainly(join, df, label)
        if "sketch" in table.columns:
            made.append(table.count())
        return table

    monkeypatch.setattr(setjoin._Join, "kept", counted)
    own = lambda k, n: [f"own{k}x{i}" for i in range(n)]
    rows = [(k, " ".join([f"p{k // 3}x{i}" for i in range(60)] + own(k, 40))) for k in range(30)]
    rows.append((30, rows[4][1] + " and more"))
    got = setjoin.jaccard_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(map(tuple, got.collect())) == ordered(plain(rows))
    assert made and max(made) <= len(rows)


def test_equal_fingerprints_hide_no_near_copies(spark, monkeypatch):
    """One word repeated outweighs all else, so a dozen pairs of near copies have one fingerprint; ball hashing proposes each set with the smallest only, the set join finds the rest."""
    made = []
    plainly = setjoin._ball_pairs

    def counted(*args):
        pairs = plainly(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(setjoin, "_ball_pairs", counted)
    base = "x " * 4000
    rows = [(2 * g + more, base + " ".join([f"g{g}w{k}" for k in range(60)] + ["more"] * more)) for g in range(12) for more in (0, 1)]
    got = setjoin.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 24, 2))
    assert made == [len(rows) - 1]
