"""Damaged conversations, their faults, and the cheapest edits that repair them.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are put in a global
order and cut into slices of equal length, so a conversation of any length is spread.
The rows of a conversation in a slice are a segment: equal consecutive symbols (role
initial and fault) are one run, and a segment is the min-plus product of its runs, each
taken from cached binary powers of the transition of its symbol. Costs to the end pass
backward over the segments of a conversation, states forward, one row for each; the
choices of a run are then unrolled by halving, which equal halves share.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.layout import global_order
from ..session import cut_lineage
from .common import Batches, batch_of, mapped

SLICE_ROWS = 4096
#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
_FAR = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"
#: Faults in the order in which they count, and the kinds of role initials.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: States: nothing yet, after s, after u, after a; the first and the last may end.
_STEP = [{SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2}]
_NEXT = [USER, USER, ASSISTANT, USER]  # what can be inserted or written over, by state
#: Costs of what is missing at the end, by state.
END = (0, 2 * INSERT, INSERT, 0)


# --- input --------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv`` (the id as text, a space for null), ``conv_id``, ``turn``, ``role``,
    ``text`` of the rows after damage by crc32(`conv_id:turn`) % 20; a null role, text,
    id or turn is a space there."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = named("text")
    return conversations.select(
        named("conv_id").alias("conv"),
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(named("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their ``place`` in the order of conversation, turn (nulls first), role
    and text, ``key`` (the same for equal role and text), ``initial``, ``blank`` and
    ``truncated``. Equal rows are told apart by a running number alone, so that many of
    them are spread too."""
    bare = F.rtrim("text", F.lit(_BLANKS))
    kind = F.substring("role", 1, 1)
    marked = rows.select(
        "conv", "conv_id", "turn", "role", "text",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("key"),
        F.when(kind == "s", SYSTEM).when(kind == "u", USER).when(kind == "a", ASSISTANT).otherwise(OTHER).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return global_order(marked, ["conv", "turn", "role", "key", "_row"], "place").drop("_part", "_row")


def faults(ordered: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``initial`` and ``fault``, the first that a row has."""
    first = ordered.groupBy("conv", "key").agg(F.min("place").alias("first"))
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(F.col("truncated"), TRUNCATED)
    )
    light = ordered.select("conv", "key", "place", "initial", "blank", "truncated").join(first, ["conv", "key"])
    return light.select("conv", "place", "initial", F.coalesce(fault, F.lit(FINE)).alias("fault"))


# --- min-plus -----------------------------------------------------------------------

Matrix = tuple[tuple[int, ...], ...]
UNIT: Matrix = tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_FAR, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def ahead_of(a: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a stretch, by those after it."""
    return tuple(min(a[i][k] + costs[k] for k in range(4)) for i in range(4))


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, in the order of the letters."""
    initial, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT if fault == TRUNCATED else 0
        if initial in _STEP[state]:
            out.append(("K", more, _STEP[state][initial]))
        out.append(("R", RENAME + more, _STEP[state][_NEXT[state]]))
    return out


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k rows of a symbol, inserted rows before each included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    before = [list(row) for row in UNIT]
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            at, cost = _STEP[at][_NEXT[at]], cost + INSERT
            before[state][at] = min(before[state][at], cost)
    edit = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in _choices(symbol, state):
            edit[state][to] = min(edit[state][to], cost)
    return product(tuple(map(tuple, before)), tuple(map(tuple, edit)))


def run_costs(symbol: int, count: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a run, by those after it."""
    for k in range(count.bit_length()):
        if count >> k & 1:
            costs = ahead_of(power(symbol, k), costs)
    return costs


Runs = tuple[tuple[int, int], ...]  # (symbol, rows)


@lru_cache(maxsize=50_000)
def transition(runs: Runs) -> Matrix:
    out = UNIT
    for symbol, count in runs:
        for k in range(count.bit_length()):
            if count >> k & 1:
                out = product(out, power(symbol, k))
    return out


@lru_cache(maxsize=50_000)
def unroll(symbol: int, count: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least letters of a run among the cheapest, and the state behind it. ``after``
    are the costs to the end behind the run, less the smallest."""
    if count > 1:
        first = 1 << (count - 1).bit_length() - 1
        between = _less(run_costs(symbol, count - first, after))
        left, state = unroll(symbol, first, state, between)
        right, state = unroll(symbol, count - first, state, after)
        return left + right, state
    here, letters = ahead_of(power(symbol, 0), after), ""
    while True:
        options = _choices(symbol, state)
        put = _STEP[state][_NEXT[state]]
        options.insert(1, ("I", INSERT, put))
        for letter, cost, to in options:
            if cost + (here if letter == "I" else after)[to] == here[state]:
                letters, state = letters + letter, to
                break
        if letter != "I":
            return letters, state


def _less(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(maxsize=50_000)
def solve(runs: Runs, state: int, after: tuple[int, ...], ends: bool) -> tuple[str, int]:
    """Letters of a segment from a state on, and the state behind it; the last one of a
    conversation also gets the rows that are missing at its end."""
    behind = [after]
    for symbol, count in reversed(runs):
        behind.append(run_costs(symbol, count, behind[-1]))
    letters = []
    for (symbol, count), costs in zip(runs, behind[-2::-1]):
        found, state = unroll(symbol, count, state, _less(costs))
        letters.append(found)
    while ends and END[state]:
        letters.append("I")
        state = _STEP[state][_NEXT[state]]
    return "".join(letters), state


@lru_cache(maxsize=50_000)
def written(letters: str, state: int, runs: Runs) -> tuple[list[int], list[int], list[str | None]]:
    """What stays of a segment: row, number of the inserted row before it (0: the row
    itself; inserted rows behind the last belong to it, counted upwards) and its new
    role, null where it keeps its own."""
    initials = [s // 4 for s, n in runs for _ in range(n)]
    rows, subs, roles, at, here = [], [], [], 0, 0
    for letter in letters:
        if letter == "I":
            last = at == len(initials)
            here += 1
            rows.append(at - last)
            subs.append(here if last else here - 10)
            roles.append(_NAMES[_NEXT[state]])
            state = _STEP[state][_NEXT[state]]
            continue
        if letter != "D":
            keeps = letter == "K"
            rows.append(at)
            subs.append(0)
            roles.append(None if keeps else _NAMES[_NEXT[state]])
            state = _STEP[state][initials[at] if keeps else _NEXT[state]]
        at, here = at + 1, 0
    return rows, subs, roles


# --- segments -----------------------------------------------------------------------

_FIGURES = "blank long, duplicate long, truncated long, illegal long"
_SEGMENT = f"conv string, slice long, place long, runs array<long>, first int, last int, {_FIGURES}"
_LEGAL = np.zeros(16, bool)
_LEGAL[[SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER]] = True


def _segments(table: pa.Table) -> pa.Table:
    """The segments of a slice, in order, with the faults they hold."""
    table = table.sort_by("place")
    conv = table.column("conv").combine_chunks()
    initial, fault = (table.column(c).to_numpy().astype(np.int64) for c in ("initial", "fault"))
    coded = np.asarray(conv.dictionary_encode().indices)
    begins = np.flatnonzero(np.diff(coded, prepend=-1))
    ends = np.append(begins[1:], len(coded))
    symbol = initial * 4 + fault
    fresh_run = np.diff(symbol, prepend=-1) != 0
    fresh_run[begins] = True
    run_at = np.flatnonzero(fresh_run)
    run_size = np.diff(np.append(run_at, len(symbol)))
    pairs = np.stack([symbol[run_at], run_size], 1).ravel()
    edges = np.append(np.searchsorted(run_at, begins), len(run_at)) * 2
    unlike = np.append(False, ~_LEGAL[initial[:-1] * 4 + initial[1:]])
    unlike[begins] = False
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), begins)
    slices = table.column("slice").to_numpy()
    return pa.table(
        {
            "conv": conv.take(pa.array(begins)),
            "slice": slices[begins],
            "place": table.column("place").to_numpy()[begins],
            "runs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs, pa.int64())),
            "first": pa.array(initial[begins], pa.int32()),
            "last": pa.array(initial[ends - 1], pa.int32()),
            "blank": total(fault == BLANK),
            "duplicate": total(fault == DUPLICATE),
            "truncated": total(fault == TRUNCATED),
            "illegal": total(unlike),
        }
    )


def _as_runs(flat: list[int]) -> Runs:
    return tuple(zip(flat[::2], flat[1::2]))


def _backward(batches: Batches) -> Batches:
    """Adds the costs to the end behind each segment; segments come last first."""
    held, costs = None, END
    for batch in batches:
        after, ends = [], []
        for conv, runs in zip(batch.column("conv").to_pylist(), batch.column("runs").to_pylist()):
            ends.append(conv != held)
            if conv != held:
                held, costs = conv, END
            after.append(costs)
            costs = ahead_of(transition(_as_runs(runs)), costs)
        columns = [*batch.columns, pa.array(after, pa.list_(pa.int64())), pa.array(ends)]
        yield batch_of(columns, [*batch.schema.names, "after", "ends"])


_DONE = f"conv string, slice long, audit string, cost long, {_FIGURES}, rows array<long>, subs array<int>, roles array<string>"


def _forward(batches: Batches) -> Batches:
    """Letters and remaining rows of each segment; segments come first to last."""
    held, state, before = None, 0, -1
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs, after = _as_runs(r["runs"]), tuple(r["after"])
            cost, illegal = 0, r["illegal"]
            if r["conv"] != held:
                held, state = r["conv"], 0
                cost = ahead_of(transition(runs), after)[0]
            else:
                illegal += not _LEGAL[before * 4 + r["first"]]
            before = r["last"]
            base = min(after)
            letters, behind = solve(runs, state, tuple(c - base for c in after), r["ends"])
            rows, subs, roles = written(letters, state, runs)
            state = behind
            figures = (r["blank"], r["duplicate"], r["truncated"], illegal)
            out.append((r["conv"], r["slice"], letters, cost, *figures, [r["place"] + i for i in rows], subs, roles))
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        kinds += [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        columns = zip(*out) if out else [[] for _ in kinds]
        yield batch_of([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _DONE.split(", ")])


def repair(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations (``conv_id``, ``turn``, ``role``, ``text``).

    report, one row for every conv_id of the input: ``gaps`` in the turns, the counted
    faults ``blank``, ``duplicate``, ``truncated``, ``illegal``, the ``cost`` and the
    ``audit`` of the cheapest edits (K, R, D, I for keep, rerole, delete, insert).
    repaired: ``conv_id``, ``place`` and ``sub`` (their order), ``turn``, ``role``,
    ``text``; inserted rows have no turn and an empty text.

    A null conv_id is a conversation of its own. Rows of equal turn come by role and
    text, so equal rows are neighbours. A role whose initial is none of s, u, a must be
    renamed or deleted. Without rows after damage all figures are 0 and the audit is
    empty; an empty table gives none; other columns are not looked at. Turns too far
    apart to count as a long leave null gaps.
    """
    ordered = in_order(damaged(conversations))
    rows = faults(ordered).withColumn("slice", F.floor(F.col("place") / slice_rows))
    cut = rows.groupBy("slice").applyInArrow(_segments, _SEGMENT)
    spread = cut.repartition("conv").sortWithinPartitions("conv", F.desc("slice"))
    costed = mapped(spread, _backward, f"{_SEGMENT}, after array<long>, ends boolean")
    done = cut_lineage(mapped(costed.sortWithinPartitions("conv", "slice"), _forward, _DONE))
    figures = ["cost", "blank", "duplicate", "truncated", "illegal"]
    parts = F.sort_array(F.collect_list(F.struct("slice", "audit")))
    found = done.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in figures], F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")
    )
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long") - F.countDistinct("turn"))
    gaps = ordered.groupBy("conv").agg(F.when(F.max("turn").isNull(), 0).otherwise(span).alias("gaps"), F.lit(True).alias("present"))
    every = conversations.select("conv_id").distinct()
    every = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    joined = every.join(found, "conv", "left").join(gaps, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = joined.select(
        "conv_id",
        F.when(F.col("present"), F.col("gaps")).otherwise(0).cast("long").alias("gaps"),
        *[zero(c) for c in figures[1:]], zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
    )
    stays = done.select(
        F.inline(F.arrays_zip(F.col("rows").alias("place"), F.col("subs").alias("sub"), F.col("roles").alias("new")))
    )
    own = F.col("sub") == 0
    repaired = stays.join(ordered.select("place", "conv_id", "turn", "role", "text"), "place").select(
        "conv_id", "place", "sub",
        F.when(own, F.col("turn")).alias("turn"),
        F.coalesce("new", "role").alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"),
    )
    return report, repaired


def _digests(batches: Batches) -> Batches:
    """sha256 of each conversation's lines, which come in order; one hash at a time."""
    held, running = None, None
    names = ["conv", "repaired_sha256"]
    for batch in batches:
        out = []
        lines = zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
        for conv, own in groupby(lines, key=lambda r: r[0]):
            if conv != held and running is not None:
                out.append((held, running.hexdigest()))
                running = None
            content = "\n".join(f"{role}:{text}" for _, role, text in own).encode()
            if running is None:
                running = hashlib.sha256(content)
            else:
                running.update(b"\n" + content)
            held = conv
        if out:
            yield batch_of([pa.array(c, pa.string()) for c in zip(*out)], names)
    if running is not None:
        yield batch_of([pa.array([held], pa.string()), pa.array([running.hexdigest()])], names)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256``, the hash of the newline-joined ``role:text``.

    A hash is sequential, so one task reads the rows of a conversation, one after
    another and without holding them; all else about a conversation is spread.
    """
    rows = repaired.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "place", "sub", "role", "text")
    spread = rows.repartition("conv").sortWithinPartitions("conv", "place", "sub")
    return mapped(spread.select("conv", "role", "text"), _digests, "conv string, repaired_sha256 string")
