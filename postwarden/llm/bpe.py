"""Byte-level BPE by a sentencepiece model made from a rank file.

The model is written directly in its wire format: every byte string of the
vocabulary becomes a piece of one character per byte, its score is its negative
rank, and the normaliser changes nothing. Piece ids are the ranks. Texts are cut
by the tokenizer's pattern, each match is encoded alone, and ids are decoded
through the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import Batches, batch_of, mapped, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A byte b is the character b + FIRST in a piece; none of these is a space.
FIRST = 256
TO_PIECE = {byte: byte + FIRST for byte in range(256)}
#: Characters cut at once, and bytes of pieces and ids kept by a worker.
SLICE, HELD = 1 << 20, 96 << 20
#: Field numbers and types of the model format.
NORMAL, UNKNOWN, BPE = 1, 2, 2

# the same classes for every engine: white space by its Unicode property
_SPACE = public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
cut = regex.compile(_SPACE).findall
_boundary = regex.compile(r"\P{White_Space}(?= \P{White_Space})")


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank, which must run from 0 without gaps."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_PIECE)


def to_token(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def serialise(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary in rank order; one unknown piece,
    which no byte string ever reaches, follows the last rank."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece(to_piece(token), -float(rank), NORMAL) for rank, token in enumerate(vocabulary)]
    pieces.append(piece("<unk>", -float(len(vocabulary)), UNKNOWN))
    trainer = _number(3, BPE) + _number(4, len(pieces)) + _number(40, len(vocabulary))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, identity)


class _Known(dict):
    """Ids of the pieces met so far, as bytes; emptied when it grows too large."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, match: str) -> bytes:
        ids = self.encode(to_piece(match.encode()))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        self.held += 200 + len(match) + len(packed)
        if self.held > HELD:
            self.clear()
            self.held = 0
        self[match] = packed
        return packed


def slices(text: str) -> Iterator[str]:
    """Parts of a long text between a character and a single space before another
    one; no match of the pattern crosses such a place or looks beyond it."""
    start = 0
    while len(text) - start > SLICE:
        found = _boundary.search(text, start + SLICE)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


class Codec:
    """Encodes and decodes by one rank file."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(path)))
        self.tokens = [to_token(self.model.id_to_piece(i)) for i in range(self.model.vocab_size() - 1)]
        self.known = _Known(self.model.encode)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids = self.known.__getitem__
        return b"".join([b"".join(map(ids, cut(part))) for part in slices(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker and rank file."""
    return Codec(path)


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) for every row.

    The ids are those of the rank file without special tokens: their strings are
    ordinary text. A null or empty text has no ids; rows may repeat; an empty table
    gives none; other columns are not looked at. ``path`` must exist on the workers.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Batches) -> Batches:
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(text) for text in batch.column("text").to_pylist()]
            yield batch_of([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return mapped(texts(docs), run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes; null ids decode to no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Batches) -> Batches:
        decode = codec(path).decode
        for batch in batches:
            found = [decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield batch_of([batch.column("doc_id"), batch.column("ids"), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")
