"""Bounds, odd rows and independent second versions of the corpus operators."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("trackloom.llm")
P = pytest.importorskip("public_tokenizers")

from trackloom.llm import bpe, common, exactdedup, linear, packing, quality, seekable, setjoin, simhash, topk, toxicity, urlfilter  # noqa: E402
from trackloom.llm.components import components  # noqa: E402

LABELS = "doc_id long, toxic int, quality int"


def test_url_rules_against_a_plain_reading(spark):
    r, rows = random.Random(3), []
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "COM", "x.com", "b.x.Com", "net", "éx.org", "", "org.net"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12", "/EN/1", "/fr/", "/fr/x", "/de/", "/de"]
    for k in range(400):
        url = r.choice(["http", "https", "", "a b"]) + r.choice(["://", "://", "://", ":/"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "?q=/es/", "#/de/", "?a://b"])
        rows.append((None if k % 50 == 0 else k, None if k % 37 == 0 else url, 1.0))
    rows += [(900, "https://a.org/" + "x" * 200_000, 2.0), rows[3], rows[3]]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, score double").repartition(3)).collect()
    model = urlfilter.fit(urlfilter.labelled_urls())

    def plain(url):
        host = path = ""
        if url is not None and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow" if model.score(host, path) >= 0.5 else "block")
        return host, path, rule, verdict

    want = [(i, *plain(u)) for i, u, _ in rows]
    key = lambda t: tuple((v is None, v or 0) if k == 0 else (v is None, v or "") for k, v in enumerate(t))
    assert sorted(((g.page_id, g.host, g.path, g.rule, g.verdict) for g in got), key=key) == sorted(want, key=key)


def test_url_sample_keeps_both_classes_whatever_the_order():
    table = urlfilter.labelled_urls()
    picked = urlfilter.bounded(table, 50)
    assert sorted(y for *_, y in picked) == [0] * 50 + [1] * 50 and urlfilter.bounded(table[::-1], 50) == picked
    assert urlfilter.fit(table, max_rows=300).score("www.casino-poker.com", "/en/1") < 0.5 and urlfilter.fit([]).score("a", "/") == 0.5


def _folded(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ta", "ro", "min", "ek", "sul", "né"]) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for i in range(210):
        words = [word() for _ in range(r.randrange(15, 60))]
        bad = i % 3 == 0
        if bad:
            words[3:3] = ["grumblefoot", "dunderhead"]
            words = [w if k % 2 else w + "!!!" for k, w in enumerate(words)]
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, int(bad), int(not bad)))
    docs += [(None, "grumblefoot dunderhead", 1.0), (None, None, 1.0), (500, "", 1.0), (3, docs[3][1], 0.5), (501, "lone " * 30_000, 1.0)]
    labels += [(0, 0, 1), (None, 1, 1), (777, 1, 0)]  # both labels, no id, no document
    return spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, LABELS), docs, labels


def test_sample_of_learning_rows(spark, corpus):
    docs, labels, rows, known = corpus
    text = {i: t or "" for i, t, _ in rows}
    valid = {i: y for i, _, y in known if i not in (0, None) and not _folded(i)}
    sample, share = common.labelled_sample(docs, labels, "quality", 10_000, 1 << 30)
    assert sorted(sample) == sorted((text[i], y) for i, y in valid.items() if i in text)
    assert share == (sum(valid.values()) + 0.5) / (len(valid) + 1)
    few, _ = common.labelled_sample(docs, labels, "quality", 7, 1 << 30)
    assert [sum(y == c for _, y in few) for c in (0, 1)] == [7, 7] and few == common.labelled_sample(docs.repartition(5), labels, "quality", 7, 1 << 30)[0]
    small, _ = common.labelled_sample(docs, labels, "quality", 10_000, 1)
    assert [sum(y == c for _, y in small) for c in (0, 1)] == [1, 1]
    assert common.labelled_sample(docs, labels.limit(0), "quality", 5, 5) == ([], None)


def test_scores_folds_and_thresholds_of_both_classifiers(spark, corpus):
    docs, labels, rows, _ = corpus
    model = quality.trained(docs, labels)
    weights = dict(zip(model.columns.tolist(), model.weights.tolist(), strict=True))

    def slow(text):
        words = [w for p in (text or "").split() for w in re.findall(r"[^\W_]+|[^\w\s]+|_+", p.lower())]
        h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
        marked = [xxhash.xxh64_intdigest(b"\x00repeat") if k and h[k] == h[k - 1] else v for k, v in enumerate(h)]
        top = 1 << 64
        counts = {}
        for c in [*marked, *((a * 0x9E3779B97F4A7C15 % top) ^ ((b + (a >> 29)) % top) for a, b in zip(marked, marked[1:], strict=False))]:
            counts[c % (1 << 18)] = counts.get(c % (1 << 18), 0) + 1
        size = math.sqrt(sum(n * n for n in counts.values())) or 1
        return 1 / (1 + math.exp(-(model.bias + sum(weights.get(c, 0) * n / size for c, n in counts.items()))))

    got = sorted((g.doc_id is None, g.doc_id or 0, round(g.score, 9), g.held_out, g.predicted) for g in quality.score_documents(docs, labels).collect())
    assert got == sorted((i is None, i or 0, round(slow(t), 9), _folded(i), int(slow(t) >= 0.5)) for i, t, _ in rows)
    bad = toxicity.trained(docs, labels)
    got = sorted((g.doc_id is None, g.doc_id or 0, round(g.score, 9), g.held_out, g.predicted) for g in toxicity.score_documents(docs, labels).collect())
    plain = lambda t: bad.score((t or "").encode())
    assert got == sorted((i is None, i or 0, round(plain(t), 9), _folded(i), int(plain(t) >= 0.7)) for i, t, _ in rows)
    for stage, keep in ((toxicity.keep_clean, lambda t: plain(t) < 0.7), (quality.keep_good, lambda t: slow(t) >= 0.5)):
        kept = stage(spark, docs, labels)
        assert kept.columns == docs.columns
        assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in kept.collect()) == sorted((i is None, i or 0, t or "") for i, t, _ in rows if keep(t))
        assert stage(spark, docs.limit(0), labels).count() == 0


def test_priors_are_not_held_back():
    assert linear.shift(0.001) == math.log(0.001 / 0.999)
    only = quality.fit([("a b", 1), ("c d", 1)])
    assert only.score(b"x") > 0.5 and quality.fit([]).score(b"x") == 0.5


def test_marks_of_any_length_are_read():
    assert not np.array_equal(quality.features(b"a !!!!")[0], quality.features(b"a !!!?")[0])


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_ids_that_need_more_than_sixteen_bits(tmp_path):
    assert (seekable.width_for(65535), seekable.width_for(65536)) == (2, 4)
    w = seekable.FileWriter(f"file://{tmp_path}/a", 2)
    with pytest.raises(ValueError):
        w.add(1, np.array([70_000], np.uint32))
    wide = seekable.FileWriter(f"file://{tmp_path}/b", 4)
    wide.add(1, np.array([70_000, 4464], np.uint32))
    wide.close()
    assert seekable.FileReader(f"file://{tmp_path}/b").ids(0).tolist() == [70_000, 4464]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    one = spark.createDataFrame([(1, "a\ufffdb")], "doc_id long, text string")
    ranks, word, byte = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))
    for f in (lambda d: bpe.encode_decode(d, ranks, P.PATTERN), lambda d: packing.token_pieces(d, word), lambda d: seekable.round_trip(spark, d, byte, P.PATTERN)):
        assert f(docs).collect() == f(one).collect()
    assert exactdedup.exact_duplicates(docs).count() == 1 and simhash.fingerprints(docs).count() == 1


def test_many_rows_of_one_id_fill_many_files(spark):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, '', concat('w', id)) as text").repartition(4)
    folder = common.new_path(spark, "ids")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = seekable.write_tokens(docs, folder, P.path("byte_bpe_50k.json"), P.PATTERN)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(files) > 2 and sum(f[2] for f in files) == 400 and seekable.read_tokens(spark, files).count() == 400


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(None if k % 3 == 0 else k, 1 + k * 37 % 900, "x", k, 1, 2, 3, 4, 5, 6) for k in range(300)] + [(None, 5, "y", 0, 0, 0, 0, 0, 0, 0)] * 700
    names = "doc_id long, length long, text string, rank int, _bucket int, _g int, _n int, _start int, _within int, _b int"
    pieces = common.Stored(spark, spark.createDataFrame(rows, names), "odd").df
    got = packing.pack_pieces(spark, pieces, 1000)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    rows_got = got.collect()
    load = {}
    for g in rows_got:
        load.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for own in load.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1000
    key = lambda t: tuple((v is None, v or 0) for v in t[:2]) + tuple(t[2:])
    assert sorted((tuple(g)[:10] for g in rows_got), key=key) == sorted(rows, key=key)


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (None, 7), (9, None), (8, 6), (6, 8)], "a long, b long")
    assert {r.node: r.label for r in components(spark, links).df.collect()} == {1: 1, 2: 1, 3: 1, 6: 6, 8: 6}
    assert components(spark, links.limit(0)).df.count() == 0


def test_vectors_of_different_lengths_and_large_components(spark):
    v = [(0, [1.0, 2.0], 7, 1), (1, [1.0], 7, 1), (2, [2.0, 1.0, 5.0], 7, 1), (3, [], 7, 1), (20, [900.0, -900.0], 7, 1)]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<float>, score int, rank int")).collect()
    q = {i: [math.floor(64 * x) for x in e] for i, e, *_ in v}
    want = []
    for i in (0, 20):
        scores = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_trie_is_emptied_without_copies_of_shared_prefixes():
    import tracemalloc

    trie, prefix = exactdedup.Trie(), b"p" * (1 << 20)
    for k in range(200):
        trie.insert(prefix + b"%03d" % k, k, 1)
    tracemalloc.start()
    n = sum(len(key) == len(prefix) + 3 for key, _ in trie.take())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 and peak < 8 << 20


def test_exact_and_near_stages_keep_what_stands_nowhere_else(spark):
    schema = "doc_id long, text string, same int, raw int, sha int, gone int, mark int"
    rows = [(5, "alpha text one"), (5, "beta text two"), (9, "beta text two"), (8, "gamma three"), (8, "delta four"), (None, "beta text two"), (None, "omega"), (8, "delta four")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema).repartition(3)
    kept = exactdedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 5, "alpha text one"), (False, 8, "delta four"), (False, 8, "gamma three"), (False, 9, "beta text two"), (True, 0, "omega")]
    text = " ".join(f"w{k}" for k in range(60))
    near = spark.createDataFrame([(1, text, 0, 0, 0, 0, 0), (5, text + " end", 0, 0, 0, 0, 0), (5, "an unrelated text", 0, 0, 0, 0, 0), (None, text + " tail", 0, 0, 0, 0, 0)], schema)
    left = setjoin.keep_one(spark, near)
    assert left.columns == near.columns and sorted(r.text for r in left.collect()) == sorted([text, "an unrelated text", text + " tail"])


def test_all_operators_ignore_columns_with_clashing_names(spark):
    names = "doc_id long, text string, digest int, sha int, owner int, copies int, fp int, key int, rep int, least int, node int, label int"
    docs = spark.createDataFrame([(1, "a b c", *range(10)), (2, "A b c", *range(10))], names)
    assert sorted(g.keep_id for g in exactdedup.exact_duplicates(docs).collect()) == [2, 2]
    assert {g.component_id for g in simhash.near_duplicates(spark, docs).collect()} == {1}
    assert setjoin.keep_one(spark, docs).select(F.col("doc_id")).collect()[0].doc_id == 1
