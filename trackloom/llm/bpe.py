"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

A rank file is turned straight into a sentencepiece BPE model: each token's
bytes are mapped to printable letters, its score is its negative rank (so the
lowest rank merges first), and normalisation is the identity. Pre-tokens are
mapped the same way and encoded; decoding maps ids back to bytes.
"""

from __future__ import annotations

import hashlib
import struct
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text
from .pretokens import Memory, TextEncoder, byte_letters, load_ranks, loaded, pack, to_letters


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (2**64 - 1))


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks.

    Piece kinds: 1 normal, 2 unknown. Trainer fields: 3 model type (2 is BPE),
    40 to 43 the ids of unknown, begin, end and padding. Normaliser fields: 1
    name, 3 to 5 dummy prefix, extra white space, escaping (all off).
    """
    letters = byte_letters()
    pieces = b"".join(_piece("".join(letters[c] for c in t), -float(rank), 1) for rank, t in enumerate(tokens))
    unknown = len(tokens)
    trainer = _number(3, 2) + _number(40, unknown) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    return pieces + _piece("<unk>", 0.0, 2) + _block(2, trainer) + _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))


class RankBpe:
    """Encoder and decoder over a rank file and a splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import sentencepiece

        self.tokens = load_ranks(ranks_path)
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(pattern)
        self.decimals = list(map(str, range(len(self.tokens))))
        self.markers, self.words = (), Memory(self.word, 300_000)
        self.newline = self.word("\n")
        self.texts = TextEncoder(self)

    def word(self, word: str) -> bytes:
        whole = self.ranks.get(word.encode())
        return pack(self.model.encode(to_letters(word)) if whole is None else [whole])

    def __call__(self, part: str, first: bool) -> bytes:
        return b"".join([self.words[w] for w in self.split.findall(part if first else " " + part)])

    def encode(self, text: str) -> array:
        return array("I", self.texts.packed(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _RoundTrip:
    def __init__(self, ranks_path: str, pattern: str, keep_ids: bool):
        self.ranks_path, self.pattern, self.keep_ids = ranks_path, pattern, keep_ids

    def __call__(self, batches):
        bpe = loaded(("rank-bpe", self.ranks_path, self.pattern), lambda: RankBpe(self.ranks_path, self.pattern))
        for batch in batches:
            out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if self.keep_ids else {})
            flat, bounds = bpe.texts.batch(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = flat[bounds[k] : bounds[k + 1]].tolist()
                back = bpe.decode(ids)
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if self.keep_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(back)
            kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int64()), "decoded": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids, and digest both.

    Columns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256; with ``keep_ids`` also ids and the decoded bytes. A
    null or empty text has no tokens; a repeated row gives a repeated result;
    other columns of ``docs`` are ignored; an empty table gives an empty
    result; a text is encoded whole, however long. Bytes that are not UTF-8 count as
    the replacement character. No shuffle: one pass over the texts.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if keep_ids else "")
    return id_and_text(docs).mapInArrow(_RoundTrip(ranks_path, pattern, keep_ids), schema)
