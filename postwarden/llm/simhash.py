"""Near copies by 64-bit SimHash and a general pigeonhole search.

Fingerprints that differ in at most ``distance`` bits are linked. The 64 bits are
grouped into blocks of correlated bits, runs of blocks make the parts of a split,
and each part gets its own threshold; thresholds that add up to ``distance - parts
+ 1`` miss no link, because differences above every threshold would add up to more
than ``distance``. Dynamic programming spreads the thresholds by estimated
candidates: a part of correlated bits has few distinct values, so it gets a low
threshold, or -1, which leaves it out. A fingerprint stands in its own cell of each
part and probes the cells within the threshold; a cell verifies its members and
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, settled
from .common import Batches, as_bytes, batch_of, fresh, mapped, texts, words_of
from .components import components
from .near import alike

BITS, BLOCK = 64, 2
SHINGLE, DISTANCE = 4, 4
#: Rows that a cell may hold; larger ones are split by a pigeonhole on the bits that are
#: left, until so few are left that a cell cannot hold more distinct fingerprints.
CELL_ROWS, LEFT_BITS = 4096, 12
#: What comparing a candidate costs in a vector loop against shuffling one probe.
CANDIDATE = 0.05
#: Shingles hashed at once, so that a very long text takes bounded memory.
CHUNK = 1 << 18


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of a text, A-Z lowered.

    Fewer than ``size`` words make one shingle; no words give 0. A bit needs more
    than half of the shingles.
    """
    words = words_of(text.lower())
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1]
    stops = ends[size - 1 :] - 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array(
            [digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist())],
            np.uint64,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Batches) -> Batches:
    for batch in batches:
        found = np.fromiter(map(fingerprint, as_bytes(batch.column("text"))), np.uint64, batch.num_rows)
        yield batch_of([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long, for every row."""
    return mapped(texts(docs), _fingerprints, "doc_id long, bits long")


# --- bits, blocks, parts and thresholds -------------------------------------------


def _columns(bits: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each fingerprint, lowest bit first."""
    return np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _count_bits(batches: Batches) -> Batches:
    both = np.zeros((BITS, BITS))
    for batch in batches:
        ones = _columns(batch.column("bits").to_numpy().astype(np.int64, copy=False)).astype(np.float32)
        both += ones.T @ ones
    cells = np.arange(BITS * BITS, dtype=np.int64)
    yield batch_of([pa.array(cells), pa.array(both.ravel().astype(np.int64))], ["cell", "n"])


def _counted(df: DataFrame, function, cells: int) -> np.ndarray:
    """The sums over all tasks of a table of ``cells`` counters, a fixed number."""
    rows = mapped(df, function, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(cells)
    for row in rows:
        out[row["cell"]] = row["n"]
    return out


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """Blocks of ``BLOCK`` bits, each begun with the bit most correlated to the rest
    and filled with the bits most correlated to the block."""
    share = np.diag(both) / n
    deviation = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / n - np.outer(share, share)) / np.outer(deviation, deviation))
    np.fill_diagonal(tie, 0)
    left, blocks = list(range(BITS)), []
    while left:
        block = [max(left, key=lambda b: tie[b, left].sum())]
        left.remove(block[0])
        while len(block) < BLOCK:
            block.append(max(left, key=lambda b: tie[b, block].sum()))
            left.remove(block[-1])
        blocks.append(block)
    return blocks


def _keys(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(bits), np.uint64)
    for place, bit in enumerate(chosen):
        out |= ((bits >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def _histograms(blocks: list[list[int]]):
    def count(batches: Batches) -> Batches:
        total = np.zeros((len(blocks), 1 << BLOCK), np.int64)
        for batch in batches:
            bits = batch.column("bits").to_numpy().view(np.uint64)
            for i, block in enumerate(blocks):
                total[i] += np.bincount(_keys(bits, block).astype(np.int64), minlength=1 << BLOCK)
        yield batch_of([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "n"])

    return count


def pair_distances(histogram: np.ndarray) -> np.ndarray:
    """Share of ordered pairs at each distance, from how often each value occurs.

    The Walsh-Hadamard transform of the squared spectrum counts the pairs for every
    difference pattern at once.
    """
    spectrum, width = histogram.astype(float), len(histogram).bit_length() - 1
    for step in (1 << i for i in range(width)):
        pairs = spectrum.reshape(-1, 2, step)
        spectrum = np.stack((pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]), 1).ravel()
    squared = spectrum**2
    for step in (1 << i for i in range(width)):
        pairs = squared.reshape(-1, 2, step)
        squared = np.stack((pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]), 1).ravel()
    counts = np.bincount(np.bitwise_count(np.arange(1 << width)), weights=squared, minlength=width + 1)
    return counts / max(counts.sum(), 1)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that add up to ``budget`` at the least cost;
    ``costs[i][t + 1]`` is what part i costs at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        longer: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, own in enumerate(row, -1):
                found = (cost + own, [*chosen, t])
                if total + t not in longer or found < longer[total + t]:
                    longer[total + t] = found
        best = longer
    return best[budget]


def plan_parts(blocks: list[list[int]], histograms: np.ndarray, n: int, distance: int = DISTANCE) -> list[Part]:
    """The split and thresholds with the fewest expected probes and candidates.

    Distances inside a block are exact over all fingerprints; across blocks they
    are folded as if independent, which grouping correlated bits makes plausible.
    """
    inside = [pair_distances(h) for h in histograms]
    best: tuple[float, list[Part]] | None = None
    for parts in range(1, distance + 2):
        runs = np.array_split(np.arange(len(blocks)), parts)
        costs, members = [], []
        for run in runs:
            apart = np.ones(1)
            for block in run:
                apart = np.convolve(apart, inside[block])
            width = sum(len(blocks[block]) for block in run)
            costs.append(
                [0.0]
                + [
                    n * sum(comb(width, d) for d in range(t + 1)) + CANDIDATE * n * n / 2 * apart[: t + 1].sum()
                    for t in range(distance + 1)
                ]
            )
            members.append(tuple(bit for block in run for bit in blocks[block]))
        cost, thresholds = allocate(costs, distance - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, [Part(b, t) for b, t in zip(members, thresholds) if t >= 0])
    return best[1]


def _masks(width: int, threshold: int) -> np.ndarray:
    """All patterns of up to ``threshold`` ones, the empty one first."""
    found = [sum(1 << b for b in on) for d in range(threshold + 1) for on in combinations(range(width), d)]
    return np.array(found, np.uint64)


def _probes(parts: list[Part]):
    masks = [_masks(len(p.bits), p.threshold) for p in parts]

    def emit(batches: Batches) -> Batches:
        for batch in batches:
            whole = batch.column("bits").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 4096):
                bits = whole[at : at + 4096]
                for i, part in enumerate(parts):
                    cells = _keys(bits, list(part.bits))[:, None] ^ masks[i][None, :]
                    own = np.zeros(cells.shape, bool)
                    own[:, 0] = True
                    yield batch_of(
                        [
                            pa.array(np.full(cells.size, i, np.int32)),
                            pa.array(cells.ravel().view(np.int64)),
                            pa.array(np.repeat(bits.view(np.int64), len(masks[i]))),
                            pa.array(own.ravel()),
                        ],
                        ["part", "cell", "bits", "own"],
                    )

    return emit


# --- verification -----------------------------------------------------------------


def _forest(bits: np.ndarray, own: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links that connect what is connected in one group: a walk that compares each
    reached member only with those not reached yet. Every pair with an owner in it
    is compared unless another path already joins it."""
    todo, links = np.arange(len(bits)), []
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            near = (np.bitwise_count(bits[todo] ^ bits[at]) <= distance) & (own[todo] | own[at])
            if near.any():
                hit, todo = todo[near], todo[~near]
                links.append(np.stack((np.full(len(hit), bits[at]), bits[hit]), 1))
                front.extend(hit)
    return links


def verify_groups(group: np.ndarray, bits: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """Links inside runs of equal ``group``; owners come first in each run."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    end = np.repeat(starts + sizes, sizes)
    large = np.repeat(sizes > 64, sizes)
    links = []
    at, lag = np.flatnonzero(own & ~large), 1
    while len(at := at[at + lag < end[at]]):
        near = np.bitwise_count(bits[at] ^ bits[at + lag]) <= distance
        links.append(np.stack((bits[at[near]], bits[at[near] + lag]), 1))
        lag += 1
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        links += _forest(bits[start : start + size], own[start : start + size], distance)
    if not links:
        return np.zeros((0, 2), np.uint64)
    found = np.concatenate(links)
    found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)
    return found


def _verify(distance: int):
    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] | None = None

        def result(key: np.ndarray, bits: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(bits):
                found = verify_groups(key, bits, own, distance).view(np.int64)
                yield batch_of([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column("cell").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)]
            now.append(batch.column("own").to_numpy(zero_copy_only=False))
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now)]
            key = np.cumsum(np.concatenate(([False], now[0][1:] != now[0][:-1])))
            last = int(np.searchsorted(key, key[-1]))
            yield from result(key[:last], now[1][:last], now[2][:last])
            held = [column[last:] for column in now]
        if held is not None:
            yield from result(np.zeros(len(held[0]), np.int64), held[1], held[2])

    return run


def _split(groups: int):
    """Each row into ``groups`` smaller cells by the bits that its cell does not fix."""

    def emit(batches: Batches) -> Batches:
        for batch in batches:
            bits, cell = batch.column("bits").to_numpy().view(np.uint64), batch.column("cell").to_numpy()
            fixed, own = batch.column("fixed").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)
            for mask in np.unique(fixed):
                rows = fixed == mask
                free = [b for b in range(BITS) if not int(mask) >> b & 1]
                for run in np.array_split(free, groups):
                    chosen = np.uint64(sum(1 << int(b) for b in run))
                    n = int(rows.sum())
                    values = (bits[rows] & chosen).view(np.int64)
                    both = np.full(n, mask | chosen, np.uint64).view(np.int64)
                    columns = [cell[rows], both, values, bits[rows].view(np.int64), own[rows]]
                    yield batch_of([pa.array(c) for c in columns], ["cell", "fixed", "value", "bits", "own"])

    return emit


def _links(distinct: DataFrame, parts: list[Part], distance: int, cell_rows: int) -> DataFrame:
    """Links from all cells. Fingerprints of a cell that differ in at most ``distance``
    bits agree in one of ``distance + 1`` groups of the bits that are left, so a large
    cell is split into cells of those groups: a fixed number of rows for each row,
    whatever the size of the cell."""
    probes = mapped(distinct, _probes(parts), "part int, cell long, bits long, own boolean")
    fixed = F.element_at(
        F.array([F.lit(int(np.uint64(sum(1 << b for b in p.bits)).view(np.int64))) for p in parts]), F.col("part") + 1
    )
    # a hash of two cells alike puts them together, which costs time and no link
    rows = probes.select(F.xxhash64("part", "cell").alias("cell"), fixed.alias("fixed"), "bits", "own")
    small = None
    while True:
        counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.bit_count("fixed")).alias("set"))
        large = counts.filter((F.col("n") > cell_rows) & (BITS - F.col("set") > LEFT_BITS)).select("cell")
        large = cut_lineage(large)
        done = large.isEmpty()
        kept = rows if done else rows.join(large, "cell", "left_anti")
        kept = kept.select("cell", "bits", "own")
        small = kept if small is None else small.unionByName(kept)
        if done:
            break
        finer = mapped(rows.join(large, "cell"), _split(distance + 1), "cell long, fixed long, value long, bits long, own boolean")
        rows = cut_lineage(finer.select(F.xxhash64("cell", "fixed", "value").alias("cell"), "fixed", "bits", "own"))
    dealt = small.repartition("cell").sortWithinPartitions("cell", F.desc("own"))
    return mapped(dealt, _verify(distance), "a long, b long").distinct()


def link_fingerprints(found: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a``, ``b``: links between distinct ``bits`` that connect all of them that
    are connected by steps of at most ``distance`` bits."""
    distinct = cut_lineage(found.select("bits").distinct())
    n = distinct.count()
    blocks = group_bits(_counted(distinct, _count_bits, BITS * BITS).reshape(BITS, BITS), max(n, 1))
    histograms = _counted(distinct, _histograms(blocks), len(blocks) << BLOCK).reshape(len(blocks), -1)
    return _links(distinct, plan_parts(blocks, histograms, n, distance), distance, cell_rows)


def near_copies(docs: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id``, ``bits``, ``component_id`` for every row of ``docs``.

    Every row stands by its text alone: a null text is empty, texts without words
    have fingerprint 0 and are linked like any other, rows that repeat a doc_id may
    differ in component. ``component_id`` is the smallest doc_id of the component;
    null ids never become one, so a component of null ids alone has null. An empty
    table gives no rows; columns beside doc_id and text are not looked at.
    """
    found = cut_lineage(fingerprints(docs))
    groups = components(link_fingerprints(found, distance, cell_rows))
    lowest = found.groupBy("bits").agg(F.min("doc_id").alias("lowest"))
    named = lowest.join(groups.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    named = cut_lineage(named)
    roots = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = named.join(roots, "component").select("bits", "component_id")
    return found.join(named, "bits").select("doc_id", "bits", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: of each group of texts that links of five-word Jaccard
    likeness 0.8 connect, the row with the smallest doc_id stays, all columns as they are.

    The components of the fingerprints (``near_copies``) are compared first, each link by
    an exact count; keys of minima (``near``) then find the likenesses of 0.8 and more that
    differ in more bits, among what the fingerprints have not joined.

    Of unlike texts that repeat a doc_id each stands by itself; of alike ones that of
    the smallest hash stays. Rows with a null doc_id cannot be named by a group, so all
    of them stay. The texts are shuffled once, by doc_id and their hash, for the join
    and the choice among repeated rows alike.
    """
    mark, order, own = fresh(docs, "near_id"), fresh(docs, "near_order"), fresh(docs, "near_text")
    its = fresh(docs, "near_kept")
    plain = docs.filter(F.col("doc_id").isNotNull())
    # the operator names texts by their hash, as unlike texts may repeat a doc_id
    hashes = texts(plain).select(F.xxhash64("text").alias("doc_id"), "text")

    def chosen() -> DataFrame:
        groups = near_copies(hashes).select(F.col("doc_id").alias("text"), F.col("component_id").alias("group"))
        found = alike(plain, groups.distinct())
        first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text")).alias("first"))
        return first.select(F.col("first.doc_id").alias(mark), F.col("first.text").alias(its)).distinct()

    # the sets of shingles take more disk than the texts, and nothing needs them from here on
    kept = settled(chosen)
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    one = F.row_number().over(Window.partitionBy("doc_id", own).orderBy("doc_id"))
    same = (hashed["doc_id"] == kept[mark]) & (hashed[own] == kept[its])
    named = hashed.join(kept, same).withColumn(order, one).filter(F.col(order) == 1)
    unnamed = docs.filter(F.col("doc_id").isNull())
    return named.select(*docs.columns).union(unnamed)
