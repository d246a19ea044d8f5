"""Encoding of whole texts through a bounded memory of pieces between spaces.

All three vocabularies split a text before merging, and every single space
between two other visible characters is such a split. So a text is cut there,
each piece is encoded once, and its ids are remembered as packed bytes; the
ids of a text are the concatenation. Texts in which some piece begins or ends
with white space are cut with a look-around pattern instead, which keeps runs
of white space whole.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces for which the library's splitting is restated with a pattern here; all others go to the library whole.
PLAIN = re.compile(r"[!-~¡-ɏ](?:[!-~¡-ɏ\n]*[!-~¡-ɏ])?")
SPACED = re.compile(r"(?<=\S) (?=\S)")
#: All white space, as Python and the vocabularies' patterns have it.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, the others follow from 256 up."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


#: A word of Latin letters (without the two that stand for space and line feed, and İ), and a mark that is a word of its own behind one.
WORD, TAIL = r"\A[A-Za-zÀ-ÖØ-öø-ĉċ-ğġ-įıĴ-ɏ]+\z", r"[.,;:!?)]\z"
#: Pieces that a Python worker remembers.
MEMORY = 300_000
_TABLE = {i: c for i, c in enumerate(byte_letters())}
#: The same as 16-bit letters, with 2 and 1 in the stead of space and line feed.
_LETTERS = np.array([ord(c) for c in byte_letters()], "<u2")
_LETTERS[[2, 1]] = _LETTERS[[32, 10]]


def to_letters(text: str) -> str:
    if text.isascii() and (text.isalpha() or text[0] == " " and text[1:].isalpha()):
        return "Ġ" + text[1:] if text[0] == " " else text
    return text.encode().decode("latin-1").translate(_TABLE)


class Memory(dict):
    """Values by key, computed when missing. It holds ``most`` at the most, in two halves: a full younger one replaces the older, so what recurs stays. Long keys are not kept."""

    def __init__(self, make, most: int = MEMORY):
        super().__init__()
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def keep(self, key, value) -> None:
        if len(key) <= 80:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            self.keep(key, value)
        return value


_LOADED: dict = {}


def forget() -> None:
    """Let go of what other operators have left in this Python worker, and hand free memory back."""
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def loaded(key: tuple, make):
    """What ``make`` gives, kept in the Python worker for its later tasks; one operator's object at a time, so memories don't add up."""
    if key not in _LOADED:
        forget()
        _LOADED[key] = make()
    return _LOADED[key]


class TextEncoder:
    """The ids of texts as native unsigned 32-bit integers, one text at a time or a batch at once.

    ``piece(text, first)`` must give the packed ids of one piece; ``first``
    says that no space goes before it. ``piece.markers`` are strings that the
    library takes for special tokens, ``piece.whole_text`` encodes a text that
    holds one. Such texts, and texts in which a piece has white space at an
    end, are told apart in a batch and encoded one by one. Words by the
    hundred thousand are new in every batch, so they are encoded together
    and not remembered; odd pieces are.
    """

    def __init__(self, piece, most: int = MEMORY):
        self.first, self.later = Memory(lambda p: piece(p, True), 20_000), Memory(lambda p: piece(p, False), most)
        self.piece = piece

    def _later(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of pieces that follow a space, or begin with a line feed in its stead."""
        own, memory = self.piece, self.later
        out, old = list(map(memory.get, pieces)), memory.old
        for k, found in enumerate(out):
            if found is None:
                p = pieces[k]
                found = old.get(p)
                if found is None:
                    found = own(p, False) if p[:1] != "\n" else own.newline + own(p[1:], True)
                    memory.keep(p, found)
                out[k] = found
        return out

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        if any(m in text.lower() for m in self.piece.markers):
            return self.piece.whole_text(text)
        parts = SPACED.split(text)
        return b"".join([self.piece(p, not k) if not p or p[0].isspace() or p[-1].isspace() else self.later[p] if k else self.first[p] for k, p in enumerate(parts)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text in them). A null text is empty.

        Every distinct piece of the batch is looked up once; the ids are then
        gathered without a loop over pieces.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        odd = np.zeros(len(texts), bool)
        for m in self.piece.markers:
            odd |= pc.match_substring(texts, m, ignore_case=True).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        known = coded.dictionary
        body = pc.if_else(pc.starts_with(known, "\n"), pc.utf8_slice_codeunits(known, 1), known)
        uneven = pc.or_(pc.equal(body, ""), pc.not_equal(pc.utf8_trim(body, BLANKS), body)).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy().astype(np.int64)
        if uneven.any():
            odd |= np.logical_or.reduceat(uneven[codes], ends[:-1])
        whole, heads = np.flatnonzero(odd), ends[:-1]
        used = np.ones(len(codes), bool)
        used[heads] = False  # first pieces have a table entry of their own, whole texts have one for all their pieces
        for k in whole:
            used[ends[k] : ends[k + 1]] = False
        wanted = np.zeros(len(known), bool)
        wanted[codes[used]] = True
        table, sizes = self._table(known, wanted)
        odds, firsts = set(whole.tolist()), known.take(pa.array(codes[heads])).to_pylist()
        packed = [self.packed(texts[k].as_py()) if k in odds else self.first[p] for k, p in enumerate(firsts)]
        empty = len(sizes)
        for k in whole:
            codes[ends[k] : ends[k + 1]] = empty
        codes[heads] = empty + 1 + np.arange(len(heads))
        sizes = np.concatenate([sizes, [0], np.fromiter(map(len, packed), np.int64, len(packed)) // 4])
        ids = gathered(np.concatenate([table, np.frombuffer(b"".join(packed), np.uint32)]), sizes, codes)
        return ids, np.concatenate([[0], np.cumsum(sizes[codes])])[ends]

    def _table(self, known: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the wanted pieces, and how many each piece has (none where it isn't wanted).

        Where the piece encoder has ``many``, the words among the pieces (a
        Latin word, perhaps with a mark behind it or a line feed before it) are
        encoded together, each distinct one once; the others are remembered.
        """
        rest = wanted.copy()
        if (many := getattr(self.piece, "many", None)) is not None and len(known):
            line = pc.starts_with(known, "\n")
            body = pc.if_else(line, pc.utf8_slice_codeunits(known, 1), known)
            marked = pc.match_substring_regex(body, TAIL)
            core = pc.if_else(marked, pc.utf8_slice_codeunits(body, 0, -1), body)
            plain = pc.match_substring_regex(core, WORD).to_numpy(zero_copy_only=False) & wanted
            at = np.flatnonzero(plain)
            line, marked = line.to_numpy(zero_copy_only=False)[at], marked.to_numpy(zero_copy_only=False)[at]
            words = many.key(core.take(pa.array(at)), line).dictionary_encode()
            flat, each = many(words.dictionary)
            own = words.indices.to_numpy().astype(np.int64)
            sizes = np.zeros(len(known), np.int64)
            sizes[at] = each[own] + marked
            table = np.empty(int(sizes.sum()), np.uint32)
            stops = np.cumsum(sizes[at])
            tail = np.zeros(len(table), bool)
            tail[stops[marked] - 1] = True
            table[~tail] = gathered(flat, each, own)
            marks = pc.utf8_slice_codeunits(body.take(pa.array(at[marked])), -1).dictionary_encode()
            table[tail] = np.array([self.piece.tails[m] for m in marks.dictionary.to_pylist()], np.uint32)[marks.indices.to_numpy()]
            rest &= ~plain
        others = np.flatnonzero(rest)
        packed = self._later(known.take(pa.array(others)).to_pylist())
        if getattr(self.piece, "many", None) is None or not len(known):
            sizes = np.zeros(len(known), np.int64)
            sizes[others] = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            return np.frombuffer(b"".join(packed), np.uint32), sizes
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        order = np.argsort(np.concatenate([at, others]), kind="stable")
        both = np.concatenate([sizes[at], lengths])
        sizes[others] = lengths
        return gathered(np.concatenate([table, np.frombuffer(b"".join(packed), np.uint32)]), both, order), sizes


def gathered(table: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The entries of a table of runs (of ``sizes``, one after the other) in the order asked for."""
    each = sizes[order]
    upto = np.cumsum(each)
    starts = np.concatenate([[0], np.cumsum(sizes)])[order]
    return table[np.repeat(starts - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)]


class Words:
    """Many distinct words in one call of the library: a tokenizer with the file's model that splits at a mark alone.

    ``begins`` or ``stops`` tells ids that begin or end a word; all others go
    on with it.
    """

    MARK, AT_ONCE = "|", 4_000

    def __init__(self, model, marks: np.ndarray, at_start: bool, spaced: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.marks, self.at_start, self.spaced = Tokenizer(model), marks, at_start, spaced
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.MARK)

    def key(self, words: pa.Array, line: np.ndarray) -> pa.Array:
        """What tells words apart: here the space before all that don't begin a line."""
        if not self.spaced:
            return pc.utf8_lower(words)
        return pc.binary_join_element_wise(pa.array(np.where(line, "\x01|", "\x02"), pa.large_string()), words, pa.scalar("", pa.large_string()))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All their ids, and how many each has."""
        texts = []
        for k in range(0, len(words), self.AT_ONCE):
            part = words.slice(k, self.AT_ONCE)
            texts.append(_LETTERS[np.frombuffer(self.MARK.join(part.to_pylist()).encode(), np.uint8)].tobytes().decode("utf-16-le"))
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        at = np.flatnonzero(self.marks[flat])
        bounds = np.append(at, len(flat)) if self.at_start else np.concatenate([[0], at + 1])
        if len(bounds) != len(words) + 1:
            raise ValueError("words and ids don't go together")
        return flat, np.diff(bounds)


def grouped(batches, size: int = 8 << 20):
    """(doc_ids, texts) of (doc_id, text) batches, some ``size`` bytes at once: the larger, the fewer words are new in it."""
    held, at = [], 0
    for batch in batches:
        held.append(batch)
        at += batch.nbytes
        if at >= size:
            yield held_together(held)
            held, at = [], 0
    if held:
        yield held_together(held)


def held_together(batches: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    return [i for b in batches for i in b.column(0).to_pylist()], pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in batches])


def pack(ids) -> bytes:
    return array("I", ids).tobytes()


class _Json:
    """What both kinds of ``tokenizers`` files share. Special tokens are found in a text as the library finds them."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.split, self.model = regex.compile(pattern), self.whole.model
        self.markers = tuple({t.content.lower() for t in self.whole.get_added_tokens_decoder().values()})
        self.words = Memory(self.word, 20_000)
        #: Marks that are words of their own behind a word.
        self.tails, self.newline = {c: self.whole_text(c) for c in ".,;:!?)"}, self.whole_text("\n")
        self.tails = {c: np.frombuffer(v, np.uint32)[0] for c, v in self.tails.items()}

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(to_letters(word))]).tobytes()

    def whole_text(self, text: str) -> bytes:
        return pack(self.whole.encode(text, add_special_tokens=False).ids)

    def largest(self) -> int:
        """The largest id of the vocabulary."""
        return max(self.whole.get_vocab(with_added_tokens=True).values())


class ByteLevelJson(_Json):
    """Piece encoder over a ``tokenizers`` file with byte-level splitting."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        marks = np.zeros(self.largest() + 1, bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            marks[i] = token[0] in "ĠĊ"
        self.many = Words(self.model, marks, True, True)

    def __call__(self, part: str, first: bool) -> bytes:
        text = part if first else " " + part
        if PLAIN.fullmatch(part):
            return b"".join([self.words[w] for w in self.split.findall(text)])
        return self.whole_text(text)


class WordEndJson(_Json):
    """Piece encoder over a ``tokenizers`` file that lower-cases and drops white space."""

    #: Fixed value: the word pattern of the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__(path, self.PATTERN)
        marks = np.zeros(self.largest() + 1, bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            marks[i] = token.endswith("</w>")
        self.many = Words(self.model, marks, False, False)

    def __call__(self, part: str, first: bool) -> bytes:
        if PLAIN.fullmatch(part):
            return b"".join([self.words[w] for w in self.split.findall(part.lower())])
        return self.whole_text(part)


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out
