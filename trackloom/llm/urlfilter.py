"""URL verdicts: host rules first, else logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table. Each n-gram of the host
and of the path (their field is part of the hashed text) is a column; a URL is
its set of columns scaled to length one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import sigmoid

COLUMNS = 1 << 16
#: Fixed values: (host, path, verdict) of the rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: The labelled table's stems, by topic: what hosts of junk and ordinary hosts are named with. Stems of a topic share parts of words, as real names do.
BLOCKED = (
    "casino poker slots jackpot roulette betting sportsbet lotto lottery bingo gamble blackjack wager freespins",
    "viagra cialis pills dietpills cheapmeds rxmeds steroid pharmacy-discount slimming weight-loss miracle-cure detox",
    "adult xxx porn pornhub sexcam sexchat camgirls livecams escort nude hookup erotic milf fetish",
    "payday paydayloan quick-loan fastloan easycash fastcash debtfix credit-repair cashadvance bad-credit",
    "replica replicawatch fake-watch fakebags counterfeit knockoff cheapbags outlet-rolex",
    "warez keygen crack crack-serial serials nulled torrent torrents pirate piratebay free-movies cracked",
    "free-money get-rich richquick earnmoney money-fast click-now clickbait giveaway-win prize-winner win-prize freegift bitcoin-doubler",
    "spam spammer seo-links backlinks popup-ads popunder ad-server adclick tracker-pixel clicktracker traffic-bot linkfarm",
    "malware phish phishing trojan fakelogin virus-alert hackedaccount ransom spyware stealer",
)
ALLOWED = (
    "news newsroom newspaper daily-news gazette herald journal press pressroom magazine chronicle",
    "library libraries archive archives museum museums gallery encyclopedia wiki dictionary bookshelf",
    "university college campus school highschool academy students institute faculty kindergarten teacher",
    "science physics biology chemistry astronomy research researchlab laboratory mathematics geology",
    "recipes cooking kitchen bakery baking homecooking restaurant breadbaking vegetarian cookbook",
    "garden gardening plants flowers mountain river forest wildlife birds birdwatching nature weather",
    "music orchestra theatre theater concert poetry poets film-festival photography painting dance",
    "health hospital clinic nursing council citycouncil community townhall charity government open-data volunteers",
    "software opensource developers coding programming travel railway railways trainstation football chess chessclub sports sportsclub",
)


def words_of(stems: str) -> list[str]:
    """The words of a topic: every stem, and every stem before the two that follow it."""
    held = stems.split()
    return [w for k, stem in enumerate(held) for w in (stem, stem + held[(k + 1) % len(held)], f"{stem}-{held[(k + 2) % len(held)]}")]


def made_up_names(count: int = 120) -> list[str]:
    """Names of two to four syllables without a meaning, as most ordinary hosts have; they are allowed, so that what is unknown is."""
    out = []
    for k in range(count):
        pick = np.random.default_rng(xxhash.xxh32_intdigest(f"name {k}"))
        out.append("".join("bcdfghjklmnprstvwz"[int(pick.integers(18))] + "aeiou"[int(pick.integers(5))] + ("", "", "n", "r", "s", "th", "l")[int(pick.integers(7))] for _ in range(int(pick.integers(2, 5)))))
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) of the small table; label 1 is allowed. What stands round a word, and the path, is drawn by the word and not by its label."""
    first, last = ("", "www.", "blog.", "m.", "my-", "the", "best-", "shop."), ("", "-online", "-site", "hub", "24", "-world", "club", "-info")
    ends, parts = (".com", ".net", ".org", ".info", ".example.com", ".example.net", ".co", ".eu"), ("en", "de", "fr", "es", "page", "item", "article", "view")
    out = []
    for words, label in (([w for stems in BLOCKED for w in words_of(stems)], 0), ([w for stems in ALLOWED for w in words_of(stems)] + made_up_names(), 1)):
        for word in words:
            for turn in range(5):
                pick = np.random.default_rng(xxhash.xxh32_intdigest(f"{word} {turn}"))
                a, b, c, d = (x[int(pick.integers(len(x)))] for x in (first, last, ends, parts))
                out.append((f"{a}{word}{b}{c}", f"/{d}/{int(pick.integers(10_000))}{('', '/', '.html')[int(pick.integers(3))]}", label))
    return out


def columns_of(host: str, path: str, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Distinct hashed columns of a URL's n-grams."""
    found = set()
    for field, text in (("h", host), ("p", path)):
        framed = f"^{text}$"
        for n in sizes:
            found.update(xxhash.xxh32_intdigest(field + framed[i : i + n]) % COLUMNS for i in range(len(framed) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        at = columns_of(host, path)
        return float(sigmoid(self.weights[at].sum() / np.sqrt(max(len(at), 1)) + self.bias))


def bounded(table: Sequence[tuple[str, str, int]], max_rows: int, seed: int = 5) -> list[tuple[str, str, int]]:
    """The table, or of either class ``max_rows`` rows at most, drawn with a fixed seed whatever their order."""
    out, draw = [], np.random.default_rng(seed)
    for label in (0, 1):
        rows = sorted(r for r in table if r[2] == label)
        out += rows if len(rows) <= max_rows else [rows[k] for k in np.sort(draw.permutation(len(rows))[:max_rows])]
    return out


def fit(table: Sequence[tuple[str, str, int]], rounds: int = 12, rate: float = 0.5, ridge: float = 1e-4, max_rows: int = 10_000) -> Model:
    """Stochastic gradient descent in a fixed order over at most ``max_rows`` labelled URLs of each class."""
    rows = [(columns_of(h.lower(), p), y) for h, p, y in bounded(table, max_rows)]
    w, bias, order = np.zeros(COLUMNS), 0.0, np.random.default_rng(5)
    for turn in range(rounds):
        step = rate / (1 + 0.1 * turn)
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            scale = 1 / np.sqrt(max(len(at), 1))
            slope = sigmoid(w[at].sum() * scale + bias) - y
            w[at] -= step * (slope * scale + ridge * w[at])
            bias -= 0.1 * step * slope
    return Model(w.astype(np.float32), float(bias))


class _Scored:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches):
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            scores = [self.model.score(h or "", p or "") for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    rest = pages.select(F.col("page_id").cast("long"), _after_scheme(F.col("url")).alias("rest"))
    host = F.regexp_extract("rest", r"\A([^/?#]*)", 1)
    return rest.select("page_id", _ascii_lower(host).alias("host"), F.expr(r"regexp_extract(substring(rest, length(regexp_extract(rest, '\\A([^/?#]*)', 1)) + 1), '\\A([^?#]*)', 1)").alias("path"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: Sequence[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains where the path starts with the
    rule's; of several the longest wins. Without a rule the model decides:
    allow from ``threshold`` on. A null url, or one without ``://``, has an
    empty host and path, fits no rule, and is judged by the model as such. A
    url is taken whole, however long.
    Repeated rows and rows without an id are judged like any other; other
    columns are ignored; an empty table has no rows. No shuffle.
    """
    scored = split_urls(pages).mapInArrow(_Scored(fit(labelled_urls() if table is None else table)), "page_id long, host string, path string, score double")
    rule, verdict = F.lit(None).cast(T.StringType()), F.when(F.col("score") >= threshold, "allow").otherwise("block")
    for host, path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
