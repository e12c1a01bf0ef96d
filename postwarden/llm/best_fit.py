"""Documents packed whole into training sequences by bulk-synchronous best fit.

Documents become token ids and an end id; a longer one is cut into pieces of the
sequence length, whose last piece is packed like a short document. Pieces are sorted
by length over all tasks, and so are the open gaps by the room they have, once a
round. A sweep over the sizes, of which there are at most as many as a sequence has
places, gives every gap the longest pieces that still fit it: the successor of a piece
is the smallest gap that holds it. Where several pieces have one successor, the rank
among pieces and the rank among gaps of a size decide, so each task finds the pieces
of its gaps alone. Gaps shrink, and the round repeats until none takes a piece; then
as many sequences are opened as what is left must fill.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.layout import global_order
from ..session import cut_lineage
from .common import Batches, batch_of, mapped, texts
from .word_ids import word_ids

VOCABULARY, END, LENGTH = "word_bpe_49k.json", 1, 4096
_PIECE = "row long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
#: Ids that a task holds before it hands on its pieces.
_HELD = 1 << 20


# --- pieces -------------------------------------------------------------------------


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, ``piece`` (from 0), ``start``,
    ``length``, ``ids`` (little-endian unsigned 32-bit) and their crc32, for each piece
    of at most ``length`` ids of every document with its end id.

    Row numbers differ from run to run, so the table is written before it is used.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Batches) -> Batches:
        words, row = word_ids(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out, held = [], 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"))):
                ids = np.append(ids, np.array([END], ids.dtype))
                for piece, start in enumerate(range(0, len(ids), length)):
                    raw = ids[start : start + length].astype("<u4").tobytes()
                    out.append((row, doc_id, piece, start, len(raw) // 4, raw, zlib.crc32(raw)))
                    row, held = row + 1, held + len(raw) // 4
                    if held >= _HELD:
                        yield batch_of([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
            if out:
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return mapped(texts(docs), run, _PIECE)


# --- the sweep ----------------------------------------------------------------------


class Match(NamedTuple):
    """Gaps of one size from a rank on, each of which takes ``take`` pieces of a length;
    ``first`` is the rank of the first piece among those of its length."""

    room: int
    gaps: int
    length: int
    take: int
    first: int


def sweep(gaps: dict[int, int], left: np.ndarray, used: np.ndarray) -> list[Match]:
    """One sweep over all sizes, upwards: pieces are put on a stack, and gaps of a size
    take from its top, where the longest lie. ``left`` and ``used`` count the pieces of
    each length and are moved on; matches come by size and rank.

    A gap takes one length a round, as often as it fits, but no more than its share
    where pieces of that length are scarce.
    """
    found, stack = [], []
    for size in range(1, len(left)):
        if left[size]:
            stack.append(size)
        rest = gaps.get(size, 0)
        while rest and stack:
            length = stack[-1]
            take = min(size // length, -(-int(left[length]) // rest))
            many = min(rest, int(left[length]) // take)
            if many == 0:
                take, many = int(left[length]), 1
            found.append(Match(size, many, length, take, int(used[length])))
            left[length] -= many * take
            used[length] += many * take
            rest -= many
            if not left[length]:
                stack.pop()
    return found


def _after(matches: list[Match]) -> dict[int, int]:
    """Gaps of each size once the matches are made."""
    out: dict[int, int] = {}
    for m in matches:
        room = m.room - m.take * m.length
        if room:
            out[room] = out.get(room, 0) + m.gaps
    return out


def opened(left: np.ndarray) -> int:
    """Sequences that what is left must fill at least: its ids by the sequence length,
    or one for each piece of over half."""
    length = len(left) - 1
    ids = int(left @ np.arange(len(left)))
    return max(-(-ids // length), int(left[length // 2 + 1 :].sum()))


# --- rounds -------------------------------------------------------------------------

_PLACED = "sequence_id long, room long, length long, take long, first long, offset long"


def _apply(matches: list[Match], gaps: dict[int, int], total: int):
    """Gives gaps in the order of (room, sequence_id) the pieces of their match."""
    sizes = sorted(gaps)
    start = dict(zip(sizes, np.cumsum([0, *(gaps[s] for s in sizes)]).tolist()))
    taken: dict[int, int] = {}
    begins = []
    for m in matches:
        begins.append(start[m.room] + taken.get(m.room, 0))
        taken[m.room] = taken.get(m.room, 0) + m.gaps
    table = np.array([(b, *m) for b, m in zip(begins, matches)], np.int64)
    begin, room, many, length, take, first = table[np.argsort(table[:, 0])].T

    def run(batches: Batches) -> Batches:
        for batch in batches:
            place = batch.column("place").to_numpy()
            at = np.maximum(np.searchsorted(begin, place, "right") - 1, 0)
            nth = place - begin[at]
            hit = (nth >= 0) & (nth < many[at])
            at, nth = at[hit], nth[hit]
            columns = [
                batch.column("sequence_id").to_numpy()[hit],
                room[at] - take[at] * length[at],
                length[at],
                take[at],
                first[at] + nth * take[at],
                total - room[at],
            ]
            yield batch_of([pa.array(c) for c in columns], [c.split()[0] for c in _PLACED.split(", ")])

    return run


def rounds(spark: SparkSession, left: np.ndarray) -> Iterator[DataFrame]:
    """The written table of each round: ``take`` pieces of ``length`` from rank ``first``
    on go to a sequence, from ``offset``. ``left`` counts the pieces by length."""
    total, used, number = len(left) - 1, np.zeros_like(left), 0
    sizes: dict[int, int] = {}
    table = None
    while left.any():
        matches = sweep(sizes, left, used) if sizes else []
        if not matches:
            many = opened(left)
            table = spark.range(number, number + many).select(
                (-1 - F.col("id")).alias("sequence_id"), F.lit(total).cast("long").alias("room")
            )
            sizes, number = {total: many}, number + many
            matches = sweep(sizes, left, used)
        placed = global_order(table.select("sequence_id", "room"), ["room", "sequence_id"], "place")
        done = cut_lineage(mapped(placed.select("sequence_id", "place"), _apply(matches, sizes, total), _PLACED))
        yield done
        sizes, table = _after(matches), done.filter("room > 0")


def best_fit(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of packed sequences: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Every id of every row is in one piece; only documents longer than a sequence are
    cut. Full pieces are sequences of their own; sequences of several pieces have
    negative numbers. A null or empty text is its end id; rows that repeat a doc_id are
    documents of their own; null ids stay null; an empty table gives none; other columns
    are not looked at. What comes to the driver is a count for each length below
    ``length``; what goes to the tasks in a round is a match for each pair of sizes that
    meet, at most one for each length and each size of gap.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, path, length))
    short = pieces.filter(F.col("length") < length).select(F.col("length").cast("int").alias("length"), "row")
    ordered = global_order(short, ["length", "row"], "place").drop("_part")
    left = np.zeros(length + 1, np.int64)
    for r in ordered.groupBy("length").count().collect():
        left[r["length"]] = r["count"]
    begins = np.concatenate([[0], np.cumsum(left)])[: length + 1].tolist()
    whole = pieces.filter(F.col("length") == length).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    tables = list(rounds(spark, left))
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    if not tables:
        return whole.select(*names)
    placed = tables[0]
    for other in tables[1:]:
        placed = placed.unionByName(other)
    # one start for each length, at most as many as a sequence has places
    first = F.broadcast(spark.createDataFrame(list(enumerate(begins)), "length long, begin long"))
    each = placed.join(first, "length").select(
        "sequence_id", "offset", "length", (F.col("begin") + F.col("first")).alias("at"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("nth"),
    )
    spots = each.select(
        "sequence_id", (F.col("offset") + F.col("nth") * F.col("length")).alias("offset"), (F.col("at") + F.col("nth")).alias("place")
    )
    found = ordered.select("row", "place").join(spots, "place").select("row", "sequence_id", "offset")
    return pieces.join(found, "row").select(*names).unionByName(whole.select(*names))
