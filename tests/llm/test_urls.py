"""The URL model on names it has not seen, and long URLs."""

import pytest

pytest.importorskip("trackloom.llm")

from trackloom.llm import urlfilter as u  # noqa: E402

#: Rows of the table that each word has.
TURNS = 5


def _rows():
    """(topic's stems, number of the word in its topic, word, row)."""
    words = [(stems.split(), k, w) for topics in (u.BLOCKED, u.ALLOWED) for stems in topics for k, w in enumerate(u.words_of(stems))] + [(None, k, w) for k, w in enumerate(u.made_up_names())]
    table = u.labelled_urls()
    assert len(table) == TURNS * len(words)
    return [(*words[k // TURNS], row) for k, row in enumerate(table)]


def _share(train, test):
    model = u.fit(train)
    right = [(model.score(h, p) >= 0.5) == bool(y) for h, p, y in test]
    return sum(right) / len(right)


def test_held_out_by_word_and_by_stem():
    rows = _rows()
    by_word = _share([r for _, k, _, r in rows if k % 4], [r for _, k, _, r in rows if k % 4 == 0])
    assert by_word > 0.95

    def stems(held, k):
        return {k} if held is None else {k // 3, *([(k // 3 + k % 3) % len(held)] if k % 3 else [])}

    train = [r for held, k, _, r in rows if all(s % 4 for s in stems(held, k))]
    test = [r for held, k, _, r in rows if stems(held, k) == {min(stems(held, k))} and min(stems(held, k)) % 4 == 0]
    assert len(test) > 200 and _share(train, test) > 0.65
    labels = [y for *_, y in u.labelled_urls()]
    assert 0.3 < sum(labels) / len(labels) < 0.7


def test_what_surrounds_a_word_says_nothing():
    """Endings and paths are drawn alike for both labels."""
    seen = {0: set(), 1: set()}
    for host, path, y in u.labelled_urls():
        seen[y].add(host.rsplit(".", 1)[1])
        seen[y].add(path.split("/")[1])
    assert seen[0] == seen[1]


def test_very_long_urls(spark):
    urls = [(1, "http://" + "casino" * 40_000 + ".com/" + "x" * 100_000), (2, "http://a.org/" + "y" * 200_000 + "?q"), (3, "x" * 100_000)]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert len(got[1].host) == 240_004 and len(got[1].path) == 100_001 and got[1].verdict == "block"
    assert got[2].rule == "org/" and len(got[2].path) == 200_001 and got[3].host == ""
