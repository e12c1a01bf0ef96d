"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random
import struct
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postwarden.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def twin():
    ranks = {token: rank for rank, token in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_every_token_of_the_vocabulary(twin):
    codec = bpe.codec(PATH)
    for rank, token in enumerate(bpe.read_ranks(PATH)):
        assert codec.model.encode(bpe.to_piece(token)) == [rank]


def test_every_character(twin):
    codec = bpe.codec(PATH)
    characters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(characters), 5000):
        text = "".join(f"a{c}b {c} {c}{c}" for c in characters[at : at + 5000])
        if numbers(codec.encode(text)) != twin.encode_ordinary(text):
            wrong = [c for c in characters[at : at + 5000] if numbers(codec.encode(f"a{c}b {c} {c}{c}")) != twin.encode_ordinary(f"a{c}b {c} {c}{c}")]
            assert not wrong, [hex(ord(c)) for c in wrong]


def test_random_texts(twin):
    rng, codec = random.Random(5), bpe.codec(PATH)
    alphabet = list("  \n\t\r\x0b\x1c\x85\xa0ab'sTé漢字١²½🙂!?-.") + ["'re", "  ", "\n\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        ids = codec.encode(text)
        assert numbers(ids) == twin.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_texts_are_cut_where_nothing_changes(twin, monkeypatch):
    rng, codec = random.Random(6), bpe.codec(PATH)
    text = "".join(rng.choices(["word", " ", "  ", "\n", "'s", "9", "!", " a"], k=5000))
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert len(list(bpe.slices(text))) > 20 and "".join(bpe.slices(text)) == text
    assert numbers(codec.encode(text)) == twin.encode_ordinary(text)
    assert numbers(codec.encode("x" * 20000)) == twin.encode_ordinary("x" * 20000)


def test_the_bounded_store_changes_nothing(twin, monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 1000)
    text = " ".join(f"word{i} word{i % 7}" for i in range(500))
    assert numbers(bpe.Codec(PATH).encode(text)) == twin.encode_ordinary(text)


def test_frames(spark, documents, twin):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x"), (5, "long " * 50000)]
    got = bpe.decode_ids(bpe.encode_texts(documents(rows, {"ids": F.lit(1), "decoded": F.lit("x")}))).collect()
    assert [(r["doc_id"], numbers(r["ids"]), bytes(r["decoded"])) for r in got] == [
        (i, twin.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows
    ]
    assert bpe.encode_texts(documents([])).count() == 0


def test_query(spark, twin):
    from postwarden.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_bpe"](spark, sf).collect()
    assert len(got) == len(given)
    for row in got:
        ids = twin.encode_ordinary(given[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(given[row["doc_id"]].encode()).hexdigest()
