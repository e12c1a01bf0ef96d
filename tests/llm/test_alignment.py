"""Alignment against the tokenizers' own ids and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwarden.llm import alignment
from postwarden.llm.queries import QUERIES

COLUMNS = ("n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """(A ids, B ids, A bytes, B bytes) of a text by the libraries alone."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def piece(i):
        text = second.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if second.is_byte(i) else text.replace("▁", " ").encode()

    def encode(text):
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        return a, b, [bytes(byte[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]

    return encode


def walked(plain, given):
    groups_of, links_of, sizes = {}, {}, {}
    for row, text in enumerate(given):
        a, b, x, y = plain(text) if text else ([], [], [], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            a, b, x, y = [], [], [], []
        ends = [set(), set()]
        for own, tokens in zip(ends, (x, y)):
            at = 0
            for t in tokens:
                at += len(t)
                own.add(at)
        shared = sorted(ends[0] & ends[1])
        groups, links, i, k, p, q = [], [], 0, 0, 0, 0
        for end in shared:
            begin, other = i, k
            while p < end:
                p, i = p + len(x[i]), i + 1
            while q < end:
                q, k = q + len(y[k]), k + 1
            groups.append(",".join(map(str, a[begin:i])) + "|" + ",".join(map(str, b[other:k])))
            links.append((a[i - 1], b[k - 1]))
        sizes[row], links_of[row] = (len(a), len(b)), links
        groups_of[row] = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
    count = Counter(pair for links in links_of.values() for pair in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (*sizes[r], len(links_of[r]), sum(count[p] == most[p[1]] for p in links_of[r]), sum(count[p] for p in links_of[r]), groups_of[r])
        for r in sizes
    ]


def odd_texts(seed, count):
    rng = random.Random(seed)
    alphabet = list("   \n\t\x0b\x1c\x85\xa0　▁\x00ab'STéÉİ漢字١²½🙂!?-.,;") + [" the", "ing ", "'re", "<|endoftext|>", "<s>", "</s>", "<0x41>", " Paris", "é"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("most_pairs", [0, alignment.MOST_PAIRS])
def test_equals_a_plain_walk(spark, documents, plain, most_pairs):
    given = [*odd_texts(4, 600), None, "", " ", "\n", "▁", "the cat the cat", "the cat the cat", "x" * 3000]
    rows = alignment.align_corpus(documents(list(enumerate(given)), {"row": F.lit(1), "links": F.lit(1)}), most_pairs=most_pairs).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(rows, key=lambda r: r["doc_id"])] == walked(plain, given)


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op11_alignment"](spark, sf).collect()}
    assert set(rows) == set(given)
    ids = sorted(given)
    assert [tuple(rows[i][c] for c in COLUMNS) for i in ids] == walked(plain, [given[i] for i in ids])
    assert all(r["n_groups"] == r["n_links"] for r in rows.values())


def test_long_texts_are_cut_without_a_trace(plain, monkeypatch):
    from postwarden.llm import bpe

    pair = alignment.both(public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND))
    monkeypatch.setattr(bpe, "SLICE", 50)
    text = " ".join(odd_texts(9, 400)).replace("▁", "")
    for given in (text, " ".join(text.split(" ")), " ".join(w for w in text.split(" ") if w)):
        ((a, b),) = pair.encode([given])
        x, y, _, _ = plain(given)
        assert (a.tolist(), b.tolist()) == (x, y) and len(a)


def test_an_emptied_store_changes_nothing(monkeypatch):
    paths = public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND)
    given = "the cat sat on the mat, and the dog; naïve façade coöperate " * 3
    whole = alignment.Both(*paths)
    monkeypatch.setattr(alignment, "HELD", 700)
    small = alignment.Both(*paths)
    for n in range(3):
        small.align_all(small.encode([f"{n} other words {n}{n} here"]))
        assert small.align_all(small.encode([given])) == whole.align_all(whole.encode([given]))
    assert len(whole.windows(*whole.encode([given])[0])) > 20


def test_groups_and_repeated_rows(spark, documents):
    rows = alignment.aligned(documents([(1, "Hello world"), (1, "Hello world"), (None, None)]), with_groups=True).collect()
    assert [r["groups"] for r in rows].count("") == 1
    text = next(r["groups"] for r in rows if r["groups"])
    assert hashlib.sha256(text.encode()).hexdigest() in {r["groups_sha256"] for r in rows}
    assert len({r["row"] for r in rows}) == 3


def test_empty_table(spark, documents):
    assert alignment.align_corpus(documents([])).count() == 0
    assert alignment.align_corpus(documents([]), most_pairs=-1).count() == 0


def test_chunks_give_what_whole_texts_give(monkeypatch):
    paths = public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND)
    pair = alignment.Both(*paths)
    odd = [" ".join(w for w in t.split(" ") if w) for t in odd_texts(11, 1500)]
    given = [*odd_texts(12, 500), *odd, "a\n \n b", "a\n\n b", "a \nb", "\na b", "a b\n", "it 's 're a", "a\x1c \x1cb", "", " "]
    ids = pair.encode(given)
    wanted = [(len(a), len(b), *own) for (a, b), own in zip(ids, pair.align_all(ids))]
    assert pair.align_texts(given) == wanted and 0 < len(pair.aligned)
    monkeypatch.setattr(alignment, "ALIGNED", 700)
    small = alignment.Both(*paths)
    assert [small.align_texts([t])[0] for t in given] == wanted and len(small.aligned) < len(pair.aligned)
