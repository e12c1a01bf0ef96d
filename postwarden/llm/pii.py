"""Personal data: patterns for protected entities, and the terms that reveal them.

The patterns find e-mail addresses, IP addresses, card and phone numbers. A term of
their context, a word within some words of an entity, reveals its kind by how often
the corpus has it there: with p(kind) the share of all words that stand in such a
context and p(kind | term) that of the term's occurrences, the disclosure

    1 + log p(kind | term) / -log p(kind)

is the pointwise mutual information as a share of the entity's own information: 1
for a term that always stands by the entity, 0 for one that tells nothing. Terms
above one threshold are generalised in such contexts, above a higher one removed.
Occurrences are counted over all documents and summed by shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage
from .common import Batches, Codes, as_bytes, batch_of, fresh, mapped, texts, words_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on each side of an entity; documents a term must be near an entity in;
#: disclosure from which a term is generalised and from which it is removed.
CONTEXT, SUPPORT, GENERALISE, REMOVE = 3, 5, 0.8, 0.95

#: Characters before and after the @ of an address, and the patterns
#: of the other kinds. A number's run of digits is taken whole or not at all, so
#: possessive repeats match what plain ones do, in time that grows with the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTER = re.compile(r"[^\W\d_]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: each @ with the longest run before it that no earlier
    address has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            taken = found.end()
        else:
            taken = at + 1
        at = text.find("@", taken)


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def entities(text: str) -> list[Span]:
    """The spans of all kinds in the order of KINDS, then of their starts."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# --- terms --------------------------------------------------------------------------


def term_of(word: str) -> str:
    """A word without the ASCII punctuation around it, A-Z lowered; empty if it has no letter."""
    core = word.strip(_EDGES)
    return core.translate(_LOWER) if _LETTER.search(core) else ""


_LOWER = {c: c + 32 for c in range(65, 91)}


def term_hash(term: str) -> int:
    value = xxhash.xxh64_intdigest(term.encode())
    return value - (1 << 64) if value >> 63 else value


def _before(text: str, start: int, count: int) -> Iterator[tuple[int, int]]:
    """The last words that end before ``start``, read backwards."""
    end = start
    for _ in range(count):
        while end > 0 and text[end - 1] in " \t\n\x0b\x0c\r":
            end -= 1
        first = end
        while first > 0 and text[first - 1] not in " \t\n\x0b\x0c\r":
            first -= 1
        if first == end:
            return
        yield first, end
        end = first


def near_terms(text: str, spans: list[Span], context: int) -> list[tuple[str, int, int, int]]:
    """(kind, term hash, start, end) of the terms around each span, outside all spans.

    A term near two entities of a kind counts once; its place is its core, without
    the punctuation around it.
    """
    found: dict[tuple[str, int, int], int] = {}
    covered = sorted((a, b) for _, a, b in spans)
    for kind, start, end in spans:
        # the words that an entity itself is part of are not its context
        while start > 0 and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        after = _WORD.finditer(text, _WORD.match(text, end).end() if _WORD.match(text, end) else end)
        places = list(_before(text, start, context))
        for _, m in zip(range(context), after):
            places.append(m.span())
        for a, b in places:
            word = text[a:b]
            term = term_of(word)
            if term:
                first = a + len(word) - len(word.lstrip(_EDGES))
                found[kind, first, first + len(term)] = term_hash(term)
    clear = []
    for (kind, a, b), h in found.items():
        if not any(x < b and a < y for x, y in covered):
            clear.append((kind, h, a, b))
    return clear


def _key(doc_id, text: str) -> int:
    """Rows of equal id and text share their spans; others are told apart."""
    value = xxhash.xxh64_intdigest(f"{doc_id}\n{text}".encode())
    return value - (1 << 64) if value >> 63 else value


_SPAN = "struct<kind string, start int, end int>"
_NEAR = "struct<kind string, term long, start int, end int>"


def _scan(context: int):
    names = ["doc_id", "key", "spans", "near"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("kind", pa.string()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, spans, terms = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = entities(text)
                keys.append(_key(doc_id, text))
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                around = near_terms(text, found, context) if found else []
                terms.append([dict(zip(("kind", "term", "start", "end"), t)) for t in around])
            columns = [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(spans, span), pa.array(terms, near)]
            yield batch_of(columns, names)

    return run


def _count_terms(batches: Batches) -> Batches:
    for batch in batches:
        codes = Codes()
        counts = np.zeros(0, np.int64)
        for text in as_bytes(batch.column("text")):
            found = words_of(text)
            if found:
                here = np.bincount(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
                if len(here) > len(counts):
                    counts = np.concatenate((counts, np.zeros(max(len(here), 2 * len(counts)) - len(counts), np.int64)))
                counts[: len(here)] += here
        held: dict[int, int] = {}
        for word, n in zip(codes, counts.tolist()):
            term = term_of(word.decode())
            if term:
                h = term_hash(term)
                held[h] = held.get(h, 0) + n
        yield batch_of([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])


def disclosures(found: DataFrame, docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``kind``, ``term`` (a hash) and ``disclosure`` of the terms that stand near
    entities of a kind in at least ``support`` documents."""
    near = found.select("key", F.explode("near").alias("x")).select("key", "x.kind", "x.term")
    near = near.groupBy("kind", "term", "key").agg(F.count(F.lit(1)).alias("n"))
    near = near.groupBy("kind", "term").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("texts"))
    terms = mapped(texts(docs), _count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    near, terms = cut_lineage(near), cut_lineage(terms)
    every = terms.agg(F.sum("n").alias("every")).scalar()
    kinds = near.groupBy("kind").agg(F.sum("near").alias("of_kind"))
    # one row for each of the four kinds
    kinds = kinds.select("kind", (-F.log(F.col("of_kind") / every)).alias("information"))
    told = near.filter(F.col("texts") >= support).join(terms, "term").join(F.broadcast(kinds), "kind")
    share = F.log(F.least(F.col("near") / F.col("n"), F.lit(1.0)))
    information = F.greatest("information", F.lit(1e-9))
    return told.select("kind", "term", (1 + share / information).alias("disclosure"))


def find_personal_data(
    docs: DataFrame, context: int = CONTEXT, support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame:
    """``doc_id``, ``key``, ``spans`` of the patterns and ``terms`` (spans with their
    ``disclosure``) for every row.

    Offsets are code points, ends exclusive. A null text is empty; an empty or clean
    text has no spans; rows may repeat; null ids stay null; an empty table gives
    none; columns beside doc_id and text are not looked at.
    """
    plain = texts(docs)
    found = cut_lineage(mapped(plain, _scan(context), f"doc_id long, key long, spans array<{_SPAN}>, near array<{_NEAR}>"))
    strong = cut_lineage(disclosures(found, docs, support).filter(F.col("disclosure") >= generalise))
    near = found.select("key", F.explode("near").alias("x")).select("key", "x.*").distinct()
    terms = near.join(strong, ["kind", "term"]).groupBy("key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = terms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    none = F.array().cast("array<struct<start int, end int, disclosure double>>")
    return found.join(terms, "key", "left").select("doc_id", "key", "spans", F.coalesce("terms", none).alias("terms"))


def listed(kinds: tuple[str, ...], with_terms: bool = False) -> F.Column:
    """Spans as kind:start:end, by kind and start, joined by commas."""
    line = lambda kind: lambda s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    parts = [F.transform(of(kind), line(F.lit(kind))) for kind in kinds]
    if with_terms:
        parts.append(F.transform("terms", line(F.lit(TERM))))
    return F.array_join(F.concat(*parts), ",")


def sanitised(text: str, spans: list[dict], terms: list[dict], remove: float = REMOVE) -> str:
    """Entities become [KIND], revealing terms [TERM] or nothing; where spans overlap
    the one that starts first, then the longest, stands for all of them."""
    marks = [(s["start"], -s["end"], f"[{s['kind'].upper()}]") for s in spans]
    marks += [(t["start"], -t["end"], "" if t["disclosure"] >= remove else "[TERM]") for t in terms]
    out, at = [], 0
    for start, end, mark in sorted(marks):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: personal data and revealing terms go from the texts, all
    rows stay; n_chars follows where a text changed. A null text stays null.

    Spans of all rows come by shuffle; the texts are shuffled once, by a hash of id
    and text.
    """
    key, mark = fresh(docs, "pii_key"), fresh(docs, "pii_marks")
    found = find_personal_data(docs).filter("size(spans) > 0 or size(terms) > 0")
    found = found.groupBy(F.col("key").alias(key)).agg(F.min(F.struct("spans", "terms")).alias(mark))
    names = docs.columns

    def keyed(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(names.index("doc_id")).to_pylist()
            content = batch.column(names.index("text")).to_pylist()
            keys = pa.array([_key(i, t or "") for i, t in zip(ids, content)], pa.int64())
            yield batch_of([*batch.columns, keys], [*names, key])

    def changed(batches: Batches) -> Batches:
        for batch in batches:
            at, marks = names.index("text"), batch.column(batch.num_columns - 1).to_pylist()
            columns = batch.columns[:-1]
            content = columns[at].to_pylist()
            new = [sanitised(t, m["spans"], m["terms"]) if m and t else t for t, m in zip(content, marks)]
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                where = names.index("n_chars")
                sizes = columns[where].to_pylist()
                sizes = [len(a) if a != b else n for a, b, n in zip(new, content, sizes)]
                columns[where] = pa.array(sizes, columns[where].type)
            yield batch_of(columns, names)

    with_key = mapped(docs, keyed, T.StructType([*docs.schema.fields]).add(key, T.LongType()))
    joined = with_key.join(found, key, "left").select(*names, mark)
    return mapped(joined, changed, T.StructType([*docs.schema.fields]))
