"""What the operators of this subpackage share: reading a table, words, the
held-out rule, a shard count, column names that cannot clash, and memory given back
when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is an empty one.

    All other columns, whatever their names, stay behind.
    """
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column that has no nulls."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; ``bytes.split`` cuts at just these."""
    return text.split()


class Codes(dict):
    """A small number for each word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of about ``size`` characters, cut before a space; whole if none follows."""
    start = 0
    while len(text) - start > size:
        stop = text.find(" ", start + size)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


def remainder(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` already has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """What a worker has freed goes back to the system, where its C library can do that.

    Workers are used again and wait while others work, so what they hold without use
    counts against their executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What empties the stores that a worker keeps from task to task.
_STORES: list[Callable[[], object]] = []
#: The module whose task was the last of this worker.
_LAST: list[str] = []


def kept_by_worker(empty: Callable[[], object]) -> None:
    """A store that serves the tasks of one operator; ``empty`` is called when the worker
    gets a task of another one."""
    _STORES.append(empty)


def let_go(module: str) -> None:
    """Empties all stores if the last task was not one of ``module``."""
    if _LAST != [module]:
        for empty in _STORES:
            empty()
        give_back()
        _LAST[:] = [module]


def mapped(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` with the schema last, as the rest of the code reads; the worker
    keeps no stores of other operators and gives its free memory back at the end of
    each task."""
    module = function.__module__

    def run(batches: Batches) -> Batches:
        let_go(module)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def batch_of(arrays: Sequence[pa.Array], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=list(names))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
