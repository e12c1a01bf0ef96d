"""Passages that recur across documents, removed where a smaller doc_id has them.

A window is a run of ``window`` words. Winnowing the hashes of word grams gives each
window one owner, its smallest gram, so equal windows have equal owners at equal
places, and the windows of one owner form a segment. Segments, about one for each
twenty words, are what the shuffles carry:

1. Segments with equal content are grouped; a later document's copy is covered as a
   whole. Where an owner stands in several contents, as at the ends of a passage,
   the windows of one document for each content are compared one by one.
2. Each confirmed recurring passage goes, as the phrase of its owner taken from the
   first document that has it, to the documents in question.
3. All documents are streamed through automata of these phrases, sharded so that
   one automaton holds a bounded number; every occurrence is located in the words
   themselves, and the passage around it is removed if its content is the recurring
   one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage, settled
from .common import Batches, as_bytes, batch_of, fresh, kept_by_worker, mapped, texts, words_of

#: Words of a window and of the gram that owns it.
WINDOW, GRAM = 50, 12
#: Passages in one automaton, bytes of words whose hashes a worker keeps.
SHARD, HELD = 20_000, 32 << 20
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of the words met so far; emptied when it grows too large."""

    held = 0

    def empty(self) -> None:
        self.clear()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += 150 + len(word)
        if self.held > HELD:
            self.empty()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
_hash_of = _hashes.__getitem__
kept_by_worker(_hashes.empty)


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A mixed polynomial hash for each run of ``gram`` words."""
    single = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    count = len(words) - gram + 1
    out = np.zeros(count, np.uint64)
    for i in range(gram):
        out = out * _STEP + single[i : i + count]
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def owners(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the place of its smallest, the rightmost of equals."""
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    found = np.arange(len(view)) + view.argmin(axis=1)
    return (len(grams) - 1 - found)[::-1]


class Words:
    """The words of a text, joined by single spaces, with the place of each."""

    def __init__(self, words: list[bytes]):
        self.words, self.joined = words, b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.starts = np.concatenate(([0], ends)).tolist()

    def part(self, start: int, size: int) -> bytes:
        return self.joined[self.starts[start] : self.starts[start + size] - 1]

    def digest(self, start: int, size: int) -> int:
        """Of ``size`` words from ``start``, as a signed long."""
        value = xxhash.xxh3_64_intdigest(self.part(start, size))
        return value - (1 << 64) if value >> 63 else value


def segments(words: list[bytes], window: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``gram`` hash, start, words before the owner, size and content of each segment."""
    grams = gram_hashes(words, gram)
    owner = owners(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.concatenate((first, [len(owner)]))) + window - 1
    places = owner[first]
    text = Words(words)
    for gram_hash, start, left, size in zip(
        grams[places].view(np.int64).tolist(), first.tolist(), (places - first).tolist(), sizes.tolist()
    ):
        yield gram_hash, start, left, size, text.digest(start, size)


def _emit_segments(window: int, gram: int):
    names = ["doc_id", "gram", "at", "left", "size", "content"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                if doc_id is None or len(words) < window:
                    continue
                seen = set()
                for gram_hash, start, left, size, content in segments(words, window, gram):
                    if (gram_hash, content) not in seen:
                        seen.add((gram_hash, content))
                        rows.append((doc_id, gram_hash, start, left, size, content))
                if len(rows) > 50_000:
                    yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _read_passages(window: int, gram: int):
    """Phrase of the owner, and the hashes of all windows where they are asked for."""
    names = ["doc_id", "gram", "left", "size", "content", "phrase", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for doc_id, text, wanted in zip(
                batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("wanted").to_pylist()
            ):
                known = Words(words_of(text))
                for x in wanted:
                    at, size = x["at"], x["size"]
                    # rows that repeat a doc_id may hold another text
                    if at + size > len(known.words) or known.digest(at, size) != x["content"]:
                        continue
                    windows = [known.digest(at + i, window) for i in range(size - window + 1)] if x["several"] else None
                    phrase = known.part(at + x["left"], gram)
                    rows.append((doc_id, x["gram"], x["left"], size, x["content"], phrase, windows))
                if len(rows) > 20_000:
                    yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


_PASSAGE = ["gram", "content", "left", "size"]


def recurring_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """What to remove: ``doc_id``, ``phrase``, ``left``, ``size``, ``content`` of each
    passage that repeats a smaller doc_id, and its word range ``low`` to ``high``."""
    plain = texts(docs)
    kind = "doc_id long, gram long, at int, left int, size int, content long"
    found = cut_lineage(mapped(plain, _emit_segments(window, gram), kind))
    contents = found.groupBy(*_PASSAGE).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"))
    shared = (
        contents.groupBy("gram")
        .agg(F.min("first.doc_id").alias("lowest"), F.max("last").alias("highest"), F.count(F.lit(1)).alias("n"))
        .filter("lowest < highest")
        .select("gram", (F.col("n") > 1).alias("several"))
    )
    # written, so that the join has plain shuffles on both sides and can split a hot gram
    shared = cut_lineage(shared)
    needed = cut_lineage(contents.join(shared, "gram").select(*_PASSAGE, "first.doc_id", "first.at", "last", "several"))

    wanted = needed.groupBy("doc_id").agg(F.collect_list(F.struct(*_PASSAGE, "at", "several")).alias("wanted"))
    kind = "doc_id long, gram long, left int, size int, content long, phrase binary, windows array<long>"
    read = cut_lineage(mapped(plain.join(wanted, "doc_id"), _read_passages(window, gram), kind).distinct())
    phrases = read.groupBy("gram").agg(F.min(F.struct("doc_id", "phrase")).alias("lowest")).select("gram", "lowest.phrase")
    phrases = cut_lineage(phrases)

    repeats = needed.filter("last > doc_id").select(*_PASSAGE, F.col("doc_id").alias("first"))
    whole = found.join(repeats, _PASSAGE).filter(F.col("doc_id") > F.col("first"))
    whole = whole.select("doc_id", *_PASSAGE, F.lit(0).alias("low"), F.col("size").alias("high"))

    windows = read.filter("windows is not null").select("doc_id", *_PASSAGE, F.posexplode("windows").alias("low", "window"))
    lowest = windows.groupBy("gram", "window").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    lowest = lowest.filter("lowest < highest").select("gram", "window", "lowest")
    single = windows.join(lowest, ["gram", "window"]).filter(F.col("doc_id") > F.col("lowest"))
    single = single.select("doc_id", *_PASSAGE, "low", (F.col("low") + window).alias("high"))
    return whole.union(single).join(phrases, "gram").select("doc_id", "phrase", "left", "size", "content", "low", "high")


def _covered(text: Words, passages: list[dict], automaton, codes: dict[bytes, int]) -> np.ndarray:
    """Which words of a text the passages cover, located by the automaton."""
    by_phrase: dict[bytes, dict[tuple[int, int, int], list[tuple[int, int]]]] = {}
    for x in passages:
        ranges = by_phrase.setdefault(x["phrase"], {}).setdefault((x["left"], x["size"], x["content"]), [])
        ranges.append((x["low"], x["high"]))
    change = np.zeros(len(text.words) + 1, np.int64)
    for end, (phrase, length) in automaton.iter(tuple(map(codes.get, text.words, repeat(0)))):
        for (left, size, content), ranges in by_phrase.get(phrase, {}).items():
            start = end - length + 1 - left
            if start >= 0 and start + size <= len(text.words) and text.digest(start, size) == content:
                for low, high in ranges:
                    change[start + low] += 1
                    change[start + high] -= 1
    return np.cumsum(change[:-1]) > 0


def _sharded(rows: list[tuple[bytes, list[dict] | None]], shard: int) -> Iterator[tuple[bytes, int, int]]:
    """Kept text, words and removed words of each row, in order; rows share an
    automaton until its passages reach ``shard``."""
    at = 0
    while at < len(rows):
        stop, held = at, 0
        while stop < len(rows) and (stop == at or held + len(rows[stop][1] or ()) <= shard):
            held += len(rows[stop][1] or ())
            stop += 1
        codes: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase in {x["phrase"] for _, passages in rows[at:stop] for x in passages or ()}:
            words = phrase.split(b" ")
            automaton.add_word(tuple(codes.setdefault(w, len(codes) + 1) for w in words), (phrase, len(words)))
        if held:
            automaton.make_automaton()
        for content, passages in rows[at:stop]:
            words = words_of(content)
            if not passages:
                yield b" ".join(words), len(words), 0
                continue
            gone = _covered(Words(words), passages, automaton, codes)
            yield b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), int(gone.sum())
        at = stop


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """All columns of ``docs`` and ``kept`` (the words left, joined by one space),
    ``n_words`` and ``n_removed``; each name gets underscores if ``docs`` has it.

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller doc_id; windows are judged on the input. A null text has no words.
    Rows that repeat a doc_id are one document: they do not repeat each other, and
    each loses what a smaller doc_id has. Rows with a null doc_id lend and lose
    nothing. Texts shorter than a window keep all. An empty table gives no rows.
    """
    # the segments of all texts have served once their passages are known
    passages = settled(lambda: recurring_passages(docs, window, gram))
    key, marks = fresh(docs, "passage_doc"), fresh(docs, "passages")
    gathered = passages.groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_list(F.struct("phrase", "left", "size", "content", "low", "high")).alias(marks)
    )
    joined = docs.join(gathered, docs["doc_id"] == gathered[key], "left").select(*docs.columns, marks)
    kept, n_words, n_removed = (fresh(docs, n) for n in ("kept", "n_words", "n_removed"))
    schema = T.StructType([*docs.schema.fields])
    schema = schema.add(kept, T.StringType()).add(n_words, T.LongType()).add(n_removed, T.LongType())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).fill_null(b"")
            done = list(_sharded(list(zip(text.to_pylist(), batch.column(batch.num_columns - 1).to_pylist())), shard))
            added = [
                pa.array([d[0] for d in done], pa.binary()).cast(pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ]
            yield batch_of([*batch.columns[:-1], *added], [*batch.schema.names[:-1], kept, n_words, n_removed])

    return mapped(joined, run, schema)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: repeated passages go from the texts, all rows stay.

    A text that loses words becomes its other words joined by one space, and n_chars
    follows; all other texts stay as they are.
    """
    kept, n_removed = fresh(docs, "kept"), fresh(docs, "n_removed")
    found = without_repeats(docs)
    changed = F.col(n_removed) > 0
    values = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        size = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(changed, size).otherwise(F.col("n_chars"))
    return found.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])
