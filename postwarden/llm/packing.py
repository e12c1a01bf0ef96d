"""Documents packed into training sequences with their lexical neighbours.

Documents become token ids and an end id. They are dealt to tasks in the order of a
min-hash of their id pairs, so texts with common wording meet in a task, while the
doc_id at the end of the order splits any group of copies. A task reads its
documents in shards of a bounded number of ids and gives each shard a BM25 inverted
index, with document frequencies from the whole corpus: a seed document opens a
window, its unused neighbours fill it by rank, and the last one is cut where the
window ends. What is left of a shard goes on to the next one, and the last window of
a task is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import Batches, batch_of, mapped, texts
from .word_ids import word_ids

VOCABULARY, END = "word_bpe_49k.json", 2
LENGTH = 4096
#: Ids of a task and of a shard; query terms of a seed; the usual BM25 constants.
TASK_IDS, SHARD_IDS, TERMS, K1, B = 8_000_000, 2_000_000, 12, 1.2, 0.75
_MIX, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


# --- ids ----------------------------------------------------------------------------


def pair_minima(texts: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of two neighbouring ids of each text, as signed longs; -1 for a
    text of one id. All texts are hashed at once."""
    sizes = np.array([len(ids) for ids in texts])
    flat = np.concatenate(texts).astype(np.uint64)
    pairs = flat[:-1] << np.uint64(32) | flat[1:]
    pairs *= _MIX
    pairs ^= pairs >> np.uint64(29)
    pairs *= _MIX
    pairs ^= pairs >> np.uint64(32)
    # the last id of a text has no neighbour, and all its pair could be is the largest hash
    mixed = np.append(pairs, _NONE)
    ends = np.cumsum(sizes)
    mixed[ends - 1] = _NONE
    return np.minimum.reduceat(mixed, ends - sizes).view(np.int64)


def _grouped(given: Iterator[np.ndarray], size: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Neighbouring texts of about ``size`` ids together."""
    some, held = [], 0
    for own in given:
        some.append(own)
        held += len(own)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``near`` (a min-hash of id pairs) and ``ids`` with the end id.

    ``ids`` are little-endian unsigned integers of 16 bits where the vocabulary
    allows, else of 32. A null text is empty: its end id alone.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Batches) -> Batches:
        words = word_ids(path)
        end = np.array([END], words.kind)
        for batch in batches:
            near, ids = [], []
            for some in _grouped(words.encode(batch.column("text"))):
                some = [np.append(own, end) for own in some]
                near.append(pair_minima(some))
                ids += [own.tobytes() for own in some]
            if ids:
                columns = [batch.column("doc_id"), pa.array(np.concatenate(near)), pa.array(ids, pa.binary())]
                yield batch_of(columns, ["doc_id", "near", "ids"])

    return mapped(texts(docs), run, "doc_id long, near long, ids binary")


def _count_documents(kind: str, size: int):
    def run(batches: Batches) -> Batches:
        seen, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), kind)
                places = np.arange(len(ids))
                # an id counts at the last of its places alone
                last[ids] = places
                seen[ids[last[ids] == places]] += 1
        used = np.flatnonzero(seen)
        yield batch_of([pa.array(used), pa.array(seen[used])], ["id", "n"])

    return run


# --- shards -------------------------------------------------------------------------


class Index:
    """BM25 postings of the texts of one shard by id, with corpus frequencies."""

    def __init__(self, units: list[np.ndarray], rarity: np.ndarray):
        sizes = np.array([len(u) for u in units], float)
        counted = [np.unique(u, return_counts=True) for u in units]
        self.edges = np.concatenate(([0], np.cumsum([len(t) for t, _ in counted])))
        self.terms = np.concatenate([t for t, _ in counted]).astype(np.int64)
        count = np.concatenate([c for _, c in counted]).astype(float)
        unit = np.repeat(np.arange(len(units)), np.diff(self.edges))
        damped = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        self.weight = rarity[self.terms] * count * (K1 + 1) / (count + damped[unit])
        order = np.argsort(self.terms, kind="stable")
        self.unit, self.by_term = unit[order], self.weight[order]
        self.first = np.searchsorted(self.terms[order], np.arange(len(rarity) + 1))
        self.size = len(units)

    def neighbours(self, unit: int, unused: np.ndarray) -> np.ndarray:
        """Unused texts that share one of the seed's weightiest terms, best first."""
        a, b = self.edges[unit], self.edges[unit + 1]
        top = np.argsort(-self.weight[a:b], kind="stable")[:TERMS]
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.terms[a:b][top]]
        units = np.concatenate([self.unit[s] for s in spans])
        scores = np.bincount(units, np.concatenate([self.by_term[s] for s in spans]), self.size)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


Rows = list[tuple[object, np.ndarray, int]]  # doc_id, ids, ids already placed


class Packer:
    """Fills the windows of one task, shard by shard, numbered from ``base``.

    Pieces are (doc_id, ids, start, length, sequence, offset).
    """

    def __init__(self, rarity: np.ndarray, base: int, length: int = LENGTH):
        self.rarity, self.next, self.length = rarity, base, length
        self.left: Rows = []

    def _window(self) -> int:
        self.next += 1
        return self.next - 1

    def shard(self, rows: Rows, last: bool) -> Iterator[tuple]:
        """All full windows of the rows and of what the shard before left; if it is
        the last, of everything."""
        units: Rows = []
        for doc_id, ids, start in [*self.left, *rows]:
            while len(ids) - start >= self.length:
                yield doc_id, ids, start, self.length, self._window(), 0
                start += self.length
            if start < len(ids):
                units.append((doc_id, ids, start))
        self.left = []
        if not units:
            return
        index = Index([ids[start:] for _, ids, start in units], self.rarity)
        start = np.array([s for _, _, s in units])
        rest = np.array([len(ids) for _, ids, _ in units]) - start
        unused, total = np.ones(len(units), bool), int(rest.sum())
        seeds, turn = np.argsort(-rest, kind="stable"), 0
        while total >= self.length or (last and total):
            window, at, pieces, ranked = self._window(), 0, [], iter(())
            while at < self.length and total:
                unit = next(ranked, None)
                if unit is None:  # a new window, or no neighbour left
                    while not unused[seeds[turn]]:
                        turn += 1
                    unit = int(seeds[turn])
                    ranked = iter(index.neighbours(unit, unused).tolist())
                if not unused[unit]:
                    continue
                take = int(min(rest[unit], self.length - at))
                pieces.append((*units[unit][:2], int(start[unit]), take, window, at))
                start[unit] += take
                rest[unit] -= take
                unused[unit] = rest[unit] > 0
                at, total = at + take, total - take
            yield from pieces if at == self.length else self._at_powers(pieces)
        self.left = [(*units[u][:2], int(start[u])) for u in np.flatnonzero(unused)]

    def _at_powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A window that is not full, cut into sequences of powers of two."""
        total = sum(p[3] for p in pieces)
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        window, room, at = pieces[0][4], sizes.pop(0), 0
        for doc_id, ids, start, length, _, _ in pieces:
            while length:
                if at == room:
                    window, room, at = self._window(), sizes.pop(0), 0
                take = min(length, room - at)
                yield doc_id, ids, start, take, window, at
                start, length, at = start + take, length - take, at + take


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(kind: str, rarity: np.ndarray):
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in _PIECE.split(", ")]

    def run(batches: Batches) -> Batches:
        packer = Packer(rarity, TaskContext.get().partitionId() << 32)

        def emit(rows: Rows, last: bool) -> Batches:
            out, held = [], 0
            for doc_id, ids, start, length, window, at in packer.shard(rows, last):
                piece = ids[start : start + length].astype("<u4").tobytes()
                out.append((doc_id, start, length, piece, len(ids), window, at))
                held += length
                if held > 1 << 20:
                    yield batch_of([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, held = [], 0
            if out:
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        rows, held = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                rows.append((doc_id, np.frombuffer(ids, kind), 0))
                held += len(rows[-1][1])
                if held >= SHARD_IDS:
                    yield from emit(rows, False)
                    rows, held = [], 0
        yield from emit(rows, True)

    return run


def pack(docs: DataFrame, path: str | None = None, task_ids: int = TASK_IDS) -> DataFrame:
    """Pieces of packed sequences: ``doc_id``, ``start``, ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every id of every row is in one piece; the pieces of a sequence follow without
    gaps from offset 0 and fill it to 4096 ids or to a power of two. A null or empty
    text is its end id; rows that repeat a doc_id are documents of their own, which
    their pieces do not tell apart; null ids stay null. An empty table gives none.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    words = word_ids(path)
    kind, size = words.kind, words.size
    spark = docs.sparkSession
    place = f"{scratch_path(spark)}-ids"
    coded = token_ids(docs, path)
    coded.write.option("compression", "zstd").parquet(place)
    coded = spark.read.schema(coded.schema).parquet(place)
    # one counter for each id of the vocabulary, whose size is fixed
    counts = mapped(coded.select("ids"), _count_documents(kind, size), "id long, n long")
    seen = np.zeros(size)
    for row in counts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        seen[row["id"]] = row["n"]
    rows, held = coded.agg(F.count(F.lit(1)), F.sum(F.length("ids"))).first()
    rarity = np.log1p((rows - seen + 0.5) / (seen + 0.5))
    parts = max(1, int(held or 0) // int(kind[-1]) // task_ids)
    dealt = coded.repartitionByRange(parts, "near", "doc_id").sortWithinPartitions("near", "doc_id")
    return mapped(dealt.select("doc_id", "ids"), _pack(kind, rarity), _PIECE)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last pipeline stage: the pieces with the crc32 of their ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
