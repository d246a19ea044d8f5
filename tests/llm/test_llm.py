"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("trackloom.llm")
P = pytest.importorskip("public_tokenizers")

from trackloom.llm import bpe, exactdedup, hilbert, packing, pretokens, quality, seekable, simhash, topk, toxicity, urlfilter  # noqa: E402
from trackloom.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone int, fp long, key int, cell int, rank int, size int, length int, count long"


def _texts():
    r = random.Random(2)
    words = ["alpha", "Beta", "gam-ma", "d3lta", "ep  silon", "zeta\n\n", "été", "straße", "数据", "emoji🙂", "it's", "we'LL", "\t", "x" * 300, "<|endoftext|>", "İΣς", "\x1c", "a\u0301"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    texts = [None, "", "   ", "one", "one two", "ONE two", "one TWO", long, long, "same text here", "same text here", *_texts(), "Same Text Here"]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[9], (None, "no id", None, None, None), (None, "same text here", "de", "s0", 14)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = (0.5, 1, 2, 3, 4, 5, 6, 7, 8)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprint_and_groups(spark, docs, rows, none):
    def slow(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    fps = [(i, slow(t)) for i, t, *_ in rows]
    assert sorted(((g.doc_id is None, g.doc_id or 0, g.fingerprint) for g in got)) == sorted((i is None, i or 0, f"{f:016x}") for i, f in fps)
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {}
    for g, (i, _) in zip(group, fps, strict=True):
        least[g] = min([v for v in (least.get(g), i) if v is not None], default=None)
    want = sorted((i is None, i or 0, -1 if least[g] is None else least[g]) for g, (i, _) in zip(group, fps, strict=True))
    assert sorted((g.doc_id is None, g.doc_id or 0, -1 if g.component_id is None else g.component_id) for g in got) == want
    assert simhash.near_duplicates(spark, none).count() == 0


def test_links_reach_all_within_three_bits(spark):
    r, fps = random.Random(3), set()
    for _ in range(12):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.choice([1, 2, 40])):
            y = r.choice(sorted(fps)) if r.random() < 0.3 else x
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
                y ^= 1 << b
            fps.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark, spark.createDataFrame([(signed(x),) for x in sorted(fps)], "fp long"))
    label = {x.node % (1 << 64): x.label for x in components(spark, links).df.collect()}
    order = sorted(fps)
    reach = {x: x for x in order}
    for a in order:
        for b in order:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = reach[a], reach[b]
                reach = {k: x if v == y else v for k, v in reach.items()}
    assert all((a.a ^ a.b).bit_count() <= 3 or ((a.a % (1 << 64)) ^ (a.b % (1 << 64))).bit_count() <= 3 for a in links.collect())
    for a in order:
        for b in order:
            if a != b:
                assert (reach[a] == reach[b]) == (a in label and label.get(a) == label.get(b))


def test_urls(spark, none):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12#t", "http://x.com/fr/1", "http://x.com/de/1", "http://x.org", "http://notorg/", "http://org/", "ftp://www.casino-poker.net/en/1", "http://library.example.net/en/2", "http://a.net?q=/x://y"]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert [got[k][:2] for k in (0, 1, 2)] == [("", "")] * 3
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][2] is None and got[8][2] is None and got[9][2:] == ("org/", "allow")
    assert got[10][3] == "block" and got[11][3] == "allow" and got[12][:2] == ("a.net", "")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_exact(spark, docs, rows, none):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    for budget in (48 << 20, 100):
        got = exactdedup.exact_duplicates(docs, budget).collect()
        assert len(got) == len(rows)
        by = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
        for g in got:
            known = [i for i in by[g.text_sha256] if i is not None]
            assert g.group_size == len(by[g.text_sha256]) and g.keep_id == (max(known) if known else None) and g.kept == (g.doc_id == g.keep_id)
    assert exactdedup.exact_duplicates(none).count() == 0
    kept = [r.doc_id for r in exactdedup.keep_one(spark, docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(max(i for i in ids if i is not None) for ids in groups.values() if any(i is not None for i in ids))


def test_trie_emits_subtrees():
    r = random.Random(4)
    keys = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9))) for _ in range(300)})
    trie, out = exactdedup.Trie(), []
    for k, key in enumerate(keys):
        if k % 20 == 19:
            out += trie.take(key)
        trie.insert(key, k, 1)
        trie.insert(key, None, 1)
    out += trie.take()
    assert sorted(out) == [(key, (k, 2)) for k, key in enumerate(keys)] and trie.held == 200


def test_bpe(docs, rows, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs, path, P.PATTERN, keep_ids=True).collect():
        text = r.decoded.decode()
        assert r.ids == enc.encode_ordinary(text) and r.n_tokens == len(r.ids)
    got = {r.doc_id: r.decoded_sha256 for r in bpe.encode_decode(docs, path, P.PATTERN).where("doc_id is not null").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows if i is not None}
    assert bpe.encode_decode(none, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    piece = pretokens.ByteLevelJson(P.path(name), P.PATTERN) if name.startswith("byte") else pretokens.WordEndJson(P.path(name))
    own = pretokens.TextEncoder(piece)
    many = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a\nb.\nÉté, c", "x <|endoftext|> y", "a<|EndOfText|>", "<|startoftext|>b c", "\x85x y\xa0z", *_texts()]
    for t in many:
        assert np.frombuffer(own.packed(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    for most in (600_000, 20):
        own = pretokens.TextEncoder(piece, most)
        for _ in range(2):
            ids, bounds = own.batch(pa.array([None, *many]))
            assert bounds.tolist()[:2] == [0, 0] and len(bounds) == len(many) + 2
            for k, t in enumerate(many, 1):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert own.batch(pa.array([], pa.string()))[1].tolist() == [0]


def _labelled(spark, bad, n=240):
    r = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["ta", "ro", "min", "ek", "sul"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 90))]
        label = i % 3 == 0
        if label:
            words = bad(r, words)
        texts.append((i, " ".join(words), 1.0))
        labels.append((i, int(label), int(not label)))
    return spark.createDataFrame(texts, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark, docs, none):
    def bad(r, words):
        for _ in range(4):
            words.insert(r.randrange(len(words)), r.choice(["grumblefoot", "nitwitted", "dunderhead"]))
        return words

    own, labels = _labelled(spark, bad)
    got = toxicity.score_documents(own, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(g.predicted == g.toxic for g in got) >= 0.97 * len(got) and len(got) > 50
    kept = toxicity.keep_clean(spark, own, labels)
    assert kept.columns == own.columns and kept.count() <= 170
    scored = toxicity.score_documents(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= s.score <= 1 for s in scored)
    assert toxicity.score_documents(none, labels.limit(0)).count() == 0


def test_quality(spark, docs, none):
    own, labels = _labelled(spark, lambda r, words: [w.upper() + "!!" for w in words])
    got = quality.score_documents(own, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(g.predicted == g.quality for g in got) >= 0.97 * len(got)
    assert quality.keep_good(spark, own, labels).columns == own.columns
    scored = quality.score_documents(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= s.score <= 1 for s in scored)
    assert quality.score_documents(none, labels.limit(0)).count() == 0


def test_topk(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.2, (300, 8)).astype(np.float32)
    v[50:90] = v[50]
    data = [(i, v[i].tolist()) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (7, v[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    q = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    ids, mat = np.append(np.arange(300), 7), np.vstack([q, q[7]])
    want = []
    for i in range(0, 300, 20):
        s = mat @ q[i]
        best = sorted((-int(s[k]), int(ids[k])) for k in range(301) if ids[k] != i)[:20]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(best)]
    for size in (16384, 64):
        got = topk.top_k(df, block_rows=size, query_rows=8).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 3)")).count() == 1


def test_topk_stops_reading():
    """Lists with few large values are left early, by blocks of any size; what is left is right."""
    r = np.random.default_rng(2)
    n, ids = 5000, np.arange(5000)
    skewed = np.floor(np.exp(r.normal(0, 2, (n, 12))) * (r.random((n, 12)) < 0.1)).astype(np.int64)
    flat, tied = r.integers(-9, 9, (n, 6)), np.repeat(r.integers(-3, 4, (5, 6)), n // 5, axis=0)
    reads = {}
    for name, block in (("skewed", skewed), ("flat", flat), ("tied", tied)):
        lists, qs = topk.Lists(block), np.abs(r.integers(0, 50, (9, block.shape[1]))) if name == "skewed" else r.integers(-9, 9, (9, block.shape[1]))
        qs[8] = 0
        got = list(topk.top_of_block(ids[:9] * 7, qs, ids, block, 20, lists))
        reads[name] = lists.read / (np.count_nonzero(qs) * n)
        for i, q in enumerate(qs):
            scores = block @ q
            best = [j for j in np.lexsort((ids, -scores)) if j != i * 7][:20]
            assert [(j, s) for a, j, s in got if a == i * 7] == [(int(j), int(scores[j])) for j in best]
    assert reads["skewed"] < 0.2 and max(reads.values()) <= 1
    assert [*topk.depths(10)] == [10] and [*topk.depths(5000)][-1] == 5000


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack_documents(spark, docs, path, keep_ids=True).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert (got.apply(lambda r: zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length, axis=1)).all()
    own = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows if i is not None}
    for i, g in got[got.doc_id.notna() & (got.doc_id != 9)].groupby("doc_id"):
        assert np.frombuffer(b"".join(g.sort_values("piece").ids), np.uint32).tolist() == own[i]
    assert packing.pack_documents(spark, none, path).count() == 0


def test_plan_fits_tightly():
    r = random.Random(6)
    counts = {}
    for _ in range(5000):
        n = min(4096, int(r.lognormvariate(5, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan, load = packing.Plan(counts), {}
    for length, rank, bins, first, offset in plan.runs:
        items = min([k for n, k, *_ in plan.runs if n == length and k > rank], default=counts[length]) - rank
        for k in range(items):
            load.setdefault(first + k % bins, []).append((offset + k // bins * length, length))
    for b in load.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(load) == plan.bins <= -(-sum(n * c for n, c in counts.items()) // 4096) + 2


def test_hilbert(spark, docs, rows, none):
    points = spark.range(512).select(F.array(*[F.shiftright("id", 3 * k).bitwiseAND(7) for k in range(3)]).alias("a"))
    order = sorted(points.select("a", hilbert.hilbert_index(F.col("a"), 3, 3).alias("h")).collect(), key=lambda r: r.h)
    assert [r.h for r in order] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(a.a, b.a, strict=True)) == 1 for a, b in zip(order, order[1:], strict=False))
    got = hilbert.shards(docs).toPandas()
    sizes = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == want
    assert got.sort_values(["shard", "slot"]).curve_index.is_monotonic_increasing
    # The same by a plain sort: codes by rows before a value, cells along the curve, then id, checksum, size.
    def code(values, v):
        known = [x for x in values if x is not None]
        return 0 if v is None else sum(x < v for x in known) * 15 // len(known) + 1

    along = {tuple(r.a): r.h for r in spark.range(4096).select(F.array(*[F.shiftright("id", k).bitwiseAND(15) for k in (8, 4, 0)]).alias("a")).select("a", hilbert.hilbert_index(F.col("a"), 4, 3).alias("h")).collect()}
    langs, sources = [r[2] for r in rows], [r[3] for r in rows]
    plain = []
    for i, t, lang, source, n in rows:
        cell = (code(langs, lang), code(sources, source), 0 if not n else min(15, n.bit_length() - 1))
        b = (t or "").encode()
        plain.append((along[cell], i is not None, i or 0, zlib.crc32(b), len(b) + 1, i))
    plain.sort(key=lambda r: r[:5])
    n = len(plain)
    want = []
    for k, (h, _, _, crc, size, i) in enumerate(plain):
        shard = k * 16 // n
        want.append((i is None, i or 0, crc, size, shard, k - -(-shard * n // 16), h))
    got_rows = hilbert.shards(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r["size"], r.shard, r.slot, r.curve_index) for r in got_rows) == sorted(want)
    assert hilbert.shards(none).count() == 0


def test_shards_prune_on_every_dimension(spark):
    r = random.Random(8)
    rows = [(i, "t", f"l{r.randrange(6)}", f"s{r.randrange(8)}", int(2 ** (12 * r.random()))) for i in range(3000)]
    got = hilbert.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).select("doc_id", "shard").collect()
    shard = {g.doc_id: g.shard for g in got}
    touched = lambda at: sum(len({shard[row[0]] for row in rows if row[at] == v}) for v in {row[at] for row in rows}) / len({row[at] for row in rows})
    assert touched(2) < 9 and touched(3) < 12  # of 16; by chance all of them


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = seekable.round_trip(spark, docs, path, P.PATTERN).orderBy("start").collect()
    assert len(got) == len(rows) and [g.doc_id or -1 for g in got] == sorted(g.doc_id or -1 for g in got)
    own, at = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t, *_ in rows if i is not None}, 0
    for g in got:
        assert g.start == at
        at += g.n_tokens
        if g.doc_id is not None:
            assert g.n_tokens == len(own[g.doc_id]) and g.ids_crc32 == zlib.crc32(own[g.doc_id].tobytes())
    assert seekable.round_trip(spark, none, path, P.PATTERN).count() == 0


def test_token_file_random_access(tmp_path):
    at = f"file://{tmp_path}/one.zst"
    w = seekable.FileWriter(at, 2)
    for k in range(50):
        w.add(None if k == 0 else k, np.arange(k, dtype=np.uint32))
    w.close()
    r = seekable.FileReader(at)
    assert len(r) == 50 and r.doc_id(0) is None and r.doc_id(7) == 7 and r.ids(7).tolist() == list(range(7))
    assert [(k, len(v)) for k, v in r.scan(block=64)] == [(k, k) for k in range(50)]
    raw = bytearray((tmp_path / "one.zst").read_bytes())
    raw[int(r.starts[40]) + 12] ^= 255
    (tmp_path / "one.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017 - zstandard's error or ours
        seekable.FileReader(at).ids(40)


def test_pipeline_against_plain_version(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    left = [(r.doc_id, r.text) for r in docs.collect()]
    bad = toxicity.trained(docs, labels)
    left = [(i, t) for i, t in left if bad.score(t.encode()) < 0.7]
    rest = docs.where(F.col("doc_id").isin([i for i, _ in left]))
    good = quality.trained(rest, labels)
    left = [(i, t) for i, t in left if good.score(t.encode()) >= 0.5]
    last = {}
    for i, t in left:
        last[t.encode().lower()] = max(i, last.get(t.encode().lower(), i))
    left = sorted((i, t) for i, t in left if last[t.encode().lower()] == i)
    sets = {}
    for i, t in left:
        w = t.lower().encode().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i, _ in left}
    for i, _ in left:
        for j, _ in left:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {i for i, g in group.items() if i == g}
    got = pipeline.run(spark, folder)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == kept


def _similar_texts():
    """Sources with edited copies (Jaccard around 0.8 of five-word shingles), a wide group, a common line and odd rows."""
    r, out = random.Random(5), []
    line = " ".join(f"common{k}" for k in range(12))
    for g in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([8, 60, 150, 400]))]
        for _ in range(60 if g == 0 else 5):
            own = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 45)):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            out.append(" ".join(own))
    out += [line + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    out += ["", None, "  ", "one", "ONE", "one two", "a b c d", "a b c d e", out[3].replace(" ", "\n"), out[8].upper()]
    r.shuffle(out)
    return [(None if k % 37 == 5 else k, t) for k, t in enumerate(out)]


def test_near_stage_finds_all_similar_texts(spark):
    setjoin = pytest.importorskip("trackloom.llm.setjoin")
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = _similar_texts()
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group, pairs = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y, pairs = group[a], group[b], pairs + 1
                group = [y if g == x else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((i is None, i or 0, t or "") for g, (i, t) in zip(group, rows, strict=True) if i is None or least[g] == i)
    assert pairs > 100 and len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert setjoin.keep_one(spark, docs.limit(0)).count() == 0
    other = spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1]), (2, "another text that stands nowhere else")], "doc_id long, text string")
    assert sorted(x.text for x in setjoin.keep_one(spark, other).where("doc_id = 2").collect()) == ["another text that stands nowhere else"]


def test_exact_stage_with_null_ids_and_one_id_with_two_texts(spark):
    rows = [(None, "a"), (3, "A"), (None, "b"), (None, "B"), (1, "c"), (2, "c"), (1, "only here"), (7, "d"), (7, "D"), (7, "d"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = exactdedup.keep_one(spark, docs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").lower()) for r in kept)
    assert got == [(False, 1, "only here"), (False, 2, "c"), (False, 3, "a"), (False, 4, ""), (False, 7, "d"), (True, 0, "b")]
