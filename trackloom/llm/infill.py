"""Fill-in-middle transformation with succinct rank and select over code points.

A batch of texts is one run of UTF-8 bytes. A bitvector marks the bytes that
begin a code point; it is packed into 64-bit words, and a directory holds the
number of set bits before every block of eight words. ``rank`` then counts the
code points before a byte, so the difference over a text is its n, and
``select`` turns the number of a code point into the byte it begins at. No
text is decoded: the cuts are byte positions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, unused

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: 64-bit words to a block of the directory.
WORDS = 8


class Boundaries:
    """Bitvector of the bytes that begin a code point, with its directory."""

    def __init__(self, data: np.ndarray):
        starts = (data & 0xC0) != 0x80
        packed = np.packbits(starts, bitorder="little")
        size = 8 * WORDS
        padded = np.zeros((len(packed) // size + 1) * size, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        per_word = np.bitwise_count(self.words).astype(np.int64).reshape(-1, WORDS)
        self.blocks = np.concatenate([[0], np.cumsum(per_word.sum(axis=1))])
        self.within = np.cumsum(per_word, axis=1) - per_word

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.blocks[word // WORDS] + self.within[word // WORDS, word % WORDS] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte at which each code point (from 0) begins: block by the directory, word by the block's counts, bit by halving."""
        block = np.minimum(np.searchsorted(self.blocks, k, side="right"), len(self.within)) - 1
        left = k - self.blocks[block]
        inner = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, inner]
        word, at = self.words[block * WORDS + inner], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left, at, word = np.where(up, left - low, left), np.where(up, at + width, at), np.where(up, word >> np.uint64(width), word)
        return (block * WORDS + inner) * 64 + at


def draws(doc_id: int | None, salt: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex sha256 of ``salt:doc_id``; a null id counts as no digits."""
    d = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


class _Transform:
    def __init__(self, marks, plain: int, spm: int, salt: str):
        self.marks, self.plain, self.spm, self.salt = [m.encode() for m in marks], plain, spm, salt

    def __call__(self, batches):
        for batch in batches:
            yield self.batch(batch)

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        p, s, m = self.marks
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, texts)])
        bits = Boundaries(np.frombuffer(b"".join(texts), np.uint8))
        ranks = bits.rank(ends)
        n = np.diff(ranks)
        h = np.array([draws(i, self.salt) for i in batch.column(0).to_pylist()], np.int64).reshape(-1, 4)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        plain = np.array([not t or p in t or s in t or m in t for t in texts], bool) | (h[:, 2] % 100 >= self.plain)
        spm = h[:, 3] % 100 < self.spm
        # A cut after all n units ends at the text's end, where the next text begins, or nothing does.
        cut = lambda k: np.where(k < n, bits.select(np.minimum(ranks[:-1] + k, np.maximum(ranks[-1] - 1, 0))), ends[1:]) - ends[:-1]
        a, b = cut(low), cut(high)
        form, out = [], []
        for i, t in enumerate(texts):
            prefix, middle, suffix = t[: a[i]], t[a[i] : b[i]], t[b[i] :]
            form.append("plain" if plain[i] else "spm" if spm[i] else "psm")
            out.append(t if plain[i] else b"".join((s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)))
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, marks: tuple[str, str, str] = MARKS, plain: int = 90, spm: int = 20, salt: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every document.

    The draws come from the sha256 of ``salt:doc_id``: the two cuts, plain
    from ``plain`` of 100 on, spm below ``spm`` of 100, else psm. A text that
    is null, empty or holds a mark is plain, and its counts are null. A null
    id draws as if it had no digits. Repeated rows are repeated in the result;
    other columns of ``docs``, whatever their names, are ignored; an empty
    table gives an empty result. A text is handled whole, however long; a
    batch of texts is bounded by bytes. Bytes that are not UTF-8 become the
    replacement character.
    """
    rows = id_and_text(docs).select("doc_id", F.col("text").cast("binary"))
    found = rows.mapInArrow(_Transform(marks, plain, spm, salt), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No part holds a mark, so each mark of a psm or spm output stands there once."""
    p, s, m = marks
    before, after = (lambda x, mark: F.substring_index(x, mark, 1)), (lambda x, mark: F.substring_index(x, mark, -1))
    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with sha-256 digests of the output and of the text restored from it instead of the output."""
    out = transform(docs)
    back = unused(out, "back")
    whole = out.withColumn(back, restored(F.col("output"), F.col("form")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(back).alias("restored_sha256"))
