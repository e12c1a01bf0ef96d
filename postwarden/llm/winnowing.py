"""Winnowed fingerprints in DataFrame functions alone.

Hashes of five-word grams are rolled up from word hashes by doubling (pairs, fours,
fives), and the minimum of each window of grams by doubling as well (twos, fours,
eights). Hash and position share one long, the position complemented, so that the
least value is the smallest hash and, among equal ones, the rightmost. Any run of
``GRAM + WINDOW - 1`` words that two texts share gives both a common mark.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import texts

#: Words of a gram and grams of a window; the doublings below are written for these.
GRAM, WINDOW = 5, 8
#: Low bits of a mark that hold the position, enough for a text of 2 ** 28 words.
PLACE = 28
_PLACES = (1 << PLACE) - 1
#: Rows of one slice of the order of doc_ids, and slices at most.
SLICE_ROWS, SLICES = 500, 100_000
_LOWEST = -(1 << 63)


def _later(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def _rolled(left: str, right: str, by: int) -> Column:
    return F.zip_with(left, _later(right, by), lambda x, y: F.xxhash64(x, y))


def _lesser(array: str, by: int) -> Column:
    return F.zip_with(array, _later(array, by), lambda x, y: F.least(x, y))


def with_marks(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the marks of ``text`` in order of position, an array of longs.

    A text of fewer than five words is one gram, fewer than eight grams one window;
    a text without words has no marks.
    """
    kept = df.columns
    step = df.withColumn("_w", F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), ""))
    step = step.select(*kept, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    step = step.select(*kept, "_h", _rolled("_h", "_h", 1).alias("_g"))
    step = step.select(*kept, "_h", _rolled("_g", "_g", 2).alias("_g"))
    step = step.select(*kept, F.slice(_rolled("_g", "_h", 4), 1, F.greatest(F.size("_h") - (GRAM - 1), F.lit(1))).alias("_g"))
    place = lambda g, i: g.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.lit(_PLACES) - i)
    step = step.select(*kept, F.transform("_g", place).alias("_m"))
    for by in (1, 2, 4):
        step = step.select(*kept, _lesser("_m", by).alias("_m"))
    whole = F.greatest(F.size("_m") - (WINDOW - 1), F.lit(1))
    return step.select(*kept, F.array_distinct(F.slice("_m", 1, whole)).alias(name))


def positions(marks: str) -> Column:
    """The word position of each mark's gram."""
    return F.transform(marks, lambda m: (F.lit(_PLACES) - m.bitwiseAND(F.lit(_PLACES))).cast("int"))


def hashes(marks: Column | str) -> Column:
    """The distinct hashes of marks, without their positions."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, PLACE)))


def digest(marks: str) -> Column:
    """A string of 32 hex digits over marks and positions; equal texts have equal ones."""
    parts = [F.lower(F.lpad(F.hex(F.xxhash64(*seed, marks)), 16, "0")) for seed in ([], [F.lit(1)])]
    return F.concat(*parts)


def likeness(left: str, right: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(left, right))
    together = F.size(left) + F.size(right) - shared
    return F.when(together == 0, F.lit(1.0)).otherwise(shared / together)


def winnow(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``marks`` and their word ``positions`` for every row.

    A null text is empty and has no marks; rows may repeat; an empty table gives
    none; other columns are not looked at.
    """
    return with_marks(texts(docs), "text", "marks").withColumn("positions", positions("marks"))


def _sliced(plain: DataFrame) -> DataFrame:
    """Add ``slice``: a number that grows with ``key`` and holds some hundred rows."""
    rows = plain.count()
    count = max(1, min(SLICES, rows // SLICE_ROWS))
    cuts = []
    if count > 1:
        at = [i / count for i in range(1, count)]
        cuts = plain.agg(F.percentile_approx("key", at, max(10_000, 2 * count))).first()[0]
    if not cuts:
        return plain.withColumn("slice", F.lit(0))
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    found = plain.withColumn("_x", F.col("key").cast("double"))
    found = Bucketizer(splits=splits, inputCol="_x", outputCol="_y").transform(found)
    return found.withColumn("slice", F.col("_y").cast("int")).drop("_x", "_y")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``hashes``, ``marks`` of every row and ``next_text``,
    ``next_hashes`` of the row that follows by doc_id; the last is followed by the first.

    Null ids come first, rows that repeat an id in the order of their texts; a
    single row follows itself. The texts are shuffled once, by slices of the order;
    each slice also gets the first rows of the slice after it.
    """
    plain = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    plain = _sliced(plain)
    # one row per slice, so neither the window nor the broadcast exceeds SLICES rows
    heads = plain.groupBy("slice").agg(F.min("key").alias("head"))
    order = Window.orderBy("slice")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("slice").over(order), F.max("slice").over(everything)).alias("before"))
    guests = plain.join(F.broadcast(heads), plain["key"] == heads["head"])
    guests = guests.select("doc_id", "text", "key", F.col("before").alias("slice"), F.lit(True).alias("guest"))
    both = plain.select("doc_id", "text", "key", "slice", F.lit(False).alias("guest")).unionByName(guests)
    both = with_marks(both, "text", "marks").withColumn("hashes", hashes("marks"))
    row = Window.partitionBy("slice").orderBy("guest", "key", "text")
    both = both.withColumn("next_text", F.lead("text").over(row)).withColumn("next_hashes", F.lead("hashes").over(row))
    return both.filter("not guest").select("doc_id", "text", "marks", "hashes", "next_text", "next_hashes")


def edited(docs: DataFrame) -> DataFrame:
    """``with_next`` and ``edited``: the last quarter of the code points (rounded
    down) replaced by as many from the start of the next text, or all it has; with
    its ``edited_marks`` and ``edited_hashes``."""
    found = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    start = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter)
    changed = F.concat(start, F.substring("next_text", F.lit(1), quarter))
    found = found.withColumn("edited", changed)
    return with_marks(found, "edited", "edited_marks").withColumn("edited_hashes", hashes("edited_marks"))
