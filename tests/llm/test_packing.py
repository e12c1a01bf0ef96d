"""Packing: ids against the tokenizer, and the rules of a packed table."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwarden.llm import packing
from postwarden.llm.queries import QUERIES

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, want):
    """rows: pieces with ids or their crc; want: {doc_id: ids}"""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            raw = np.array(want[doc_id][at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want[doc_id])
            assert p["ids_crc32"] == zlib.crc32(raw)
            at += p["length"]
        assert at == len(want[doc_id])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_packing"](spark, sf).collect()
    assert check(rows, {i: ids_of(tokenizer, t) for i, t in given.items()}) == 0


def test_special_tokens_are_found(documents, tokenizer):
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|EndOfText|> A"]
    rows = packing.token_ids(documents(list(enumerate(texts)))).collect()
    kind = packing.word_ids(PATH).kind
    assert {r["doc_id"]: np.frombuffer(r["ids"], kind).tolist() for r in rows} == {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}


def test_many_shards_and_tasks(spark, documents, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 9000)
    rng = random.Random(8)
    given = {i: " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 50, 700, 4095, 4096, 9000]))) for i in range(60)}
    frame = packing.pack(documents(list(given.items()), {"near": F.lit(1), "ids": F.lit(1)}), task_ids=30_000)
    rows = frame.withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check(rows, {i: ids_of(tokenizer, t) for i, t in given.items()}) == 0
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1


def test_edges(spark, documents):
    assert packing.pack(documents([])).count() == 0
    rows = packing.pack(documents([(1, None), (1, ""), (None, "\t"), (2, "a " * 10000)])).collect()
    assert sum(r["length"] for r in rows) == 3 + 10001
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in rows if r["doc_id"] != 2) == [("1", 1), ("1", 1), ("None", 1)]


def test_neighbours_share_rare_words():
    rarity = np.array([0.0, 0.1, 5.0, 5.0, 5.0])
    units = [np.array(u, "<u2") for u in ([0, 1, 2, 2], [0, 1, 3], [0, 2, 1], [1, 4], [2, 2, 2])]
    index = packing.Index(units, rarity)
    found = index.neighbours(0, np.array([False, True, True, True, True]))
    assert found[:2].tolist() == [4, 2]


def test_a_window_takes_the_nearest_texts_first():
    rarity = np.full(100, 1.0)
    rows = [(d, np.full(40, d % 2 + 10, "<u2"), 0) for d in range(10)]
    pieces = list(packing.Packer(rarity, 0, 128).shard(rows, True))
    first = {p[0] % 2 for p in pieces if p[4] == 0}
    assert len(first) == 1


def test_words_are_numbered_once_and_blanks_have_no_ids(tokenizer):
    import numpy as np
    import pyarrow as pa

    given = [None, "", " ", "  a  b\n", "a b a", "\t", "a", "É,. é.", " lead", "trail ", "a,b, c."]
    store = packing.word_ids(PATH).__class__(PATH)
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in given]
    for _ in range(2):
        assert [own.tolist() for own in store.encode(pa.array(given))] == wanted
    assert store.number[b""] == 0 and store.sizes[0] == 0
    ids = [np.array(own + [2], store.kind).tobytes() for own in wanted]
    (batch,) = packing._count_documents(store.kind, store.size)(iter([pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])]))
    counted = dict(zip(batch.column("id").to_pylist(), batch.column("n").to_pylist()))
    assert counted == {i: sum(i in {*own, 2} for own in wanted) for own in wanted for i in (*own, 2)}
