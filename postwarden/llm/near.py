"""Groups of texts by the Jaccard likeness of their five-word shingles.

Texts with equal sets of shingles are one set. Each set has ``BANDS`` keys of
``ROWS`` minima of its hashed shingles; sets that share a key meet in a cell and are
compared there by all their shingles, so every link is exact. Two sets of likeness
0.8 share a key with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993, more like ones
almost surely, at any size of the input. A cell returns a spanning forest of its
links, never all pairs; cells of the later bands are left out where the bands before
have joined all their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import Batches, as_bytes, batch_of, mapped, texts, words_of
from .components import components

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Least likeness of a link, as a fraction.
LEAST = (4, 5)
#: Bands that are searched first; the others see what these have joined.
FIRST = 4
#: Sets and shingles that one group of a cell holds, on average; larger cells are cut
#: into groups by pairs of slices, which together compare all that the cell compares.
CELL_SETS, CELL_SHINGLES = 2048, 1_000_000
#: Shingles hashed at once, and bytes of sets in a batch.
CHUNK, HELD = 1 << 13, 4 << 20

_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of all shingles of a text, A-Z lowered; fewer than
    ``size`` words make one shingle, no words none."""
    words = words_of(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band as a signed long; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), CHUNK):
        mixed = found[at : at + CHUNK, None] * _TIMES + _PLUS
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes()) - (1 << 63) for row in rows]


def _sketch(batches: Batches) -> Batches:
    names = ["row", "doc_id", "text", "key", "bands", "n", "shingles"]
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out, held = [], 0
        ids, hashes = batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist()
        for doc_id, own, text in zip(ids, hashes, as_bytes(batch.column("text"))):
            found = shingles(text)
            raw = found.tobytes()
            row += 1
            out.append((row, doc_id, own, xxhash.xxh64_intdigest(raw) - (1 << 63), band_keys(found), len(found), raw))
            held += len(raw) + 400
            if held > HELD:
                yield _rows(out, names)
                out, held = [], 0
        if out:
            yield _rows(out, names)


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return batch_of([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def numbered(values: np.ndarray) -> np.ndarray:
    """A small number for each value, the same for equal ones, without copies of all values
    that ``np.unique`` would make."""
    order = np.argsort(values)
    values = values[order]
    codes = np.zeros(len(values), np.int32)
    codes[order[1:]] = np.cumsum(values[1:] != values[:-1], dtype=np.int32)
    return codes


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among some sets: a walk that compares each
    reached set only with those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    codes = numbered(np.concatenate(sets))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    todo, flat, links = np.arange(len(sets)), codes, []
    here = np.zeros(len(codes) + 1, bool)
    over, under = LEAST

    def without(gone: np.ndarray) -> None:
        nonlocal todo, flat
        flat, todo = flat[np.repeat(~gone, sizes[todo])], todo[~gone]

    while len(todo) > 1:
        front = [int(todo[0])]
        without(np.arange(len(todo)) == 0)
        while front and len(todo):
            at = front.pop()
            own = codes[edges[at] : edges[at + 1]]
            here[own] = True
            shared = np.add.reduceat(here[flat], np.cumsum(sizes[todo]) - sizes[todo], dtype=np.int64)
            here[own] = False
            near = shared * under >= over * (sizes[todo] + len(own) - shared)
            if near.any():
                hit = todo[near].tolist()
                links += [(at, h) for h in hit]
                front += hit
                without(near)
    return links


def _compare(batches: Batches) -> Batches:
    """Links of the groups of ``cell``, ``low`` and ``high``, which come in order."""
    held, keys, sets = None, [], []

    def result() -> Batches:
        found = linked(sets) if len(sets) > 1 else []
        if found:
            yield batch_of([pa.array([keys[a] for a, _ in found]), pa.array([keys[b] for _, b in found])], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell", "low", "high", "key")]
        # one buffer for the batch; a group that goes on in the next one keeps copies
        raw = batch.column("shingles")
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        whole = np.frombuffer(raw.buffers()[2], np.uint8)
        sets = [s.copy() for s in sets]
        for cell, low, high, key, start, end in zip(*columns, ends[:-1].tolist(), ends[1:].tolist()):
            if (cell, low, high) != held:
                yield from result()
                held, keys, sets = (cell, low, high), [], []
            keys.append(key)
            sets.append(whole[start:end].view(np.uint64) if start % 8 == 0 else whole[start:end].copy().view(np.uint64))
    yield from result()


def among(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``sets`` whose ``row`` is in ``rows``, before any of them is shuffled: a bit
    for each row of ``sets`` tells, in blocks of 4,096 bytes that every task holds."""
    at = F.bitmap_bit_position("row")
    blocks = rows.groupBy(F.bitmap_bucket_number("row").alias("block")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = sets.withColumn("block", F.bitmap_bucket_number("row")).join(F.broadcast(blocks), "block")
    bit = F.element_at(F.array([F.lit(1 << b) for b in range(8)]), (at % 8 + 1).cast("int"))
    return marked.filter(byte.bitwiseAND(bit) != 0).select(*sets.columns)


def _links(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside cells; ``bands`` has ``band``, ``at``, ``key``, ``n``, ``component``
    and the ``row`` whose shingles in ``sets`` are those of the key. Cells of one component or of the same sets as another are left out."""
    mark = F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark")
    cells = bands.groupBy("band", "at").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"), F.min("key").alias("first"), mark,
        F.min("component").alias("c1"), F.max("component").alias("c2"),
    )
    cells = cells.filter(F.col("c1") != F.col("c2"))
    one = cells.groupBy("rows", "first", "mark").agg(F.min(F.struct("band", "at")).alias("p"), F.first("sum").alias("sum"))
    slices = F.ceil(F.greatest(F.col("rows") / CELL_SETS, F.col("sum") / CELL_SHINGLES)).cast("int")
    one = one.select("p.band", "p.at", F.least(slices, F.col("rows").cast("int")).alias("slices"))
    members = bands.select("band", "at", "key", "row").join(one, ["band", "at"])
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("slices")).cast("int")
    members = members.withColumn("slice", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    placed = cut_lineage(
        members.select(
            F.xxhash64("band", "at").alias("cell"),
            F.least("slice", "other").alias("low"),
            F.greatest("slice", "other").alias("high"),
            "key",
            "row",
        )
    )
    groups = ["cell", "low", "high"]
    dealt = placed.join(among(sets, placed), "row").select(*groups, "key", "shingles")
    dealt = dealt.repartition(*groups).sortWithinPartitions(*groups)
    return mapped(dealt, _compare, "a long, b long")


def alike(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``text`` (its hash), ``key`` (the set of shingles), ``component`` for
    every row.

    Rows are linked by likeness, and what links connect is one component. A null text
    is empty; texts without words are one set. An empty table gives no rows. ``groups``
    (``text``, ``group``: a hash of a text, a long) are compared before the bands.
    """
    plain = texts(docs).withColumn("hash", F.xxhash64("text"))
    columns = "row long, doc_id long, text long, key long, bands array<long>, n long, shingles binary"
    found = cut_lineage(mapped(plain, _sketch, columns))
    # one row for each set, chosen by numbers alone: no set is shuffled for the choice
    one = cut_lineage(found.groupBy("key").agg(F.min("row").alias("row")).select("row"))
    distinct = cut_lineage(found.select("row", "text", "key", "bands", "n").join(one, "row", "left_semi"))
    links = None
    named = distinct.withColumn("component", F.col("key"))
    place = ["row", "key", "n", "component"]
    banded = lambda a, b: named.select(*place, F.posexplode(F.slice("bands", a + 1, b - a)).alias("band", "at"))
    steps = [lambda: banded(0, FIRST), lambda: banded(FIRST, BANDS)]
    if groups is not None:
        given = groups.withColumnRenamed("group", "at")
        steps.insert(0, lambda: named.filter("n > 0").join(given, "text").select(*place, F.lit(-1).alias("band"), "at"))
    for step in steps:
        more = cut_lineage(_links(step(), found.select("row", "shingles")))
        links = more if links is None else links.union(more)
        joined = components(links).withColumnRenamed("node", "key")
        named = distinct.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
        named = cut_lineage(named)
    return found.select("doc_id", "text", "key").join(named.select("key", "component"), "key")
