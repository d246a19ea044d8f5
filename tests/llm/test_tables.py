"""Empty tables and clashing columns, where no other test has them."""

import pytest

pytest.importorskip("trackloom.llm")

from trackloom.llm import bpe, exactdedup, setjoin, simhash, topk  # noqa: E402

DOCS = "doc_id long, text string, same int, raw int, sha int, row int, gone int, mark int, node int, size int"


def test_empty_tables(spark):
    P = pytest.importorskip("public_tokenizers")
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(spark, none).isEmpty() and exactdedup.exact_duplicates(none).isEmpty()
    assert bpe.encode_decode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).isEmpty()
    for keep in (exactdedup.keep_one, setjoin.keep_one):
        left = keep(spark, none)
        assert left.isEmpty() and left.columns == none.columns
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, v int, g int, h int")).isEmpty()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", *range(8)), (2, "A b c d e f", *range(8)), (3, "another", *range(8))], DOCS)
    for keep, left in ((exactdedup.keep_one, {2, 3}), (setjoin.keep_one, {1, 3})):
        got = keep(spark, docs)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == left
    vectors = spark.createDataFrame([(0, [1.0, 2.0], 5, 6, 7, 8), (1, [2.0, 1.0], 5, 6, 7, 8)], "vec_id long, embedding array<float>, v int, g int, h int, rank int")
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(0, 1, 1, 64 * 64 * 4)]
