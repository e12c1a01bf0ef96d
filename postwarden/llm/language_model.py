"""A bigram language model in Elias-Fano tries, and the scores of texts by it.

Words are known by their 64-bit hash. The hash range is cut into parts, and each
part of the model is one file in the shared checkpoint folder: the first level has
the sorted hashes of its words and their counts, the second level their successors.
Hashes, pointers to the successors and the successors themselves are monotone
sequences in Elias-Fano form; the successors of a word are stored relative to the
last one of the word before. Smoothed probabilities and back-off weights are
quantised. Workers map the files into memory, which they share as pages.

Counts come from all training texts. Tasks send what they counted as compressed
blocks for each part, so no row is shuffled for a single word pair.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, scratch_path
from .common import Batches, batch_of, mapped, texts

#: Discount of pair counts; pairs of any count are kept. Training tokens for each
#: part. Bits of a quantised value.
DISCOUNT, LEAST_PAIR, PART_TOKENS, QUANTUM = 0.75, 1, 4_000_000, 65_535
#: Texts are counted and scored in runs of about so many tokens.
RUN_TOKENS = 2_000_000
END, BEGIN = b"", b" "  # neither is a word


# --- Elias-Fano sequences -----------------------------------------------------------

BLOCK = 512
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the n-th one of a byte
for _byte in range(256):
    _places = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_places)] = _places


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value in 64-bit words, and a word to spare."""
    if width == 0 or not len(values):
        return np.zeros(1, np.uint64)
    parts, rest, shifts = [], np.zeros(0, np.uint8), np.arange(width, dtype=np.uint64)
    step = 1 << 16  # a multiple of eight values, so each chunk ends on a byte
    for at in range(0, len(values), step):
        bits = (values[at : at + step, None] >> shifts & np.uint64(1)).astype(np.uint8)
        parts.append(np.packbits(bits.ravel(), bitorder="little"))
    packed = np.concatenate([*parts, rest])
    out = np.zeros(-(-len(packed) // 8) + 1, np.uint64)
    out.view(np.uint8)[: len(packed)] = packed
    return out


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A sorted array of unsigned 64-bit numbers as low bits, unary high parts and
    the number of ones before each block of the latter."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    highs = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    length = -(-((top >> width) + n + 1) // BLOCK) * BLOCK
    bits = np.zeros(length, np.uint8)
    bits[highs] = 1
    ones = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    return {
        f"{name}.shape": np.array([n, width], np.int64),
        f"{name}.low": pack_low(values, width),
        f"{name}.high": np.packbits(bits, bitorder="little"),
        f"{name}.before": np.concatenate(([0], np.cumsum(ones))),
    }


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of each 64-bit word that has ``rank`` ones before it."""
    each, top = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    counts = np.bitwise_count(word.view(np.uint8)).view(np.uint64)
    sums = counts * each  # byte i has the ones up to and with byte i
    rank = rank.astype(np.uint64)
    at = np.bitwise_count(((rank * each | top) - sums) & top).astype(np.uint64) << np.uint64(3)
    inside = rank - ((sums << np.uint64(8)) >> at & np.uint64(255))
    return at.astype(np.int64) + _SELECT[word >> at & np.uint64(255), inside]


class Sequence:
    """Reads what ``encode`` wrote; all methods take and return arrays."""

    def __init__(self, sections: dict[str, np.ndarray], name: str):
        self.size, self.width = (int(x) for x in sections[f"{name}.shape"])
        self.low, self.before = sections[f"{name}.low"], sections[f"{name}.before"]
        self.bits = sections[f"{name}.high"].view(np.uint64)
        self.high = self.bits.reshape(-1, BLOCK // 64)
        self.zeros = np.arange(len(self.before)) * BLOCK - self.before

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        place = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        # shifting by 64 is undefined, so the second word moves in two steps
        upper = (self.low[np.minimum(word + 1, len(self.low) - 1)] << (np.uint64(63) - shift)) << np.uint64(1)
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the one (or zero, with ``flip``) that has ``rank`` before it."""
        out = np.empty(len(rank), np.int64)
        for start in range(0, len(rank), 1 << 16):
            r = rank[start : start + (1 << 16)]
            block = np.searchsorted(before, r, "right") - 1
            rows = self.high[block].T
            rows = ~rows if flip else rows
            sums = np.zeros((BLOCK // 64 + 1, len(r)), np.int16)
            np.cumsum(np.bitwise_count(rows), axis=0, dtype=np.int16, out=sums[1:])
            rest = (r - before[block]).astype(np.int16)
            number = (sums[1:] <= rest).sum(axis=0)
            line = np.arange(len(r))
            word = rows[number, line]
            out[start : start + len(r)] = block * BLOCK + number * 64 + _in_word(word, rest - sums[number, line])
        return out

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many ones follow each other from a place on, 64 for that many or more."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        # a zero ends the last word, so what stands for the word behind it is not seen
        upper = self.bits[np.minimum(word + 1, len(self.bits) - 1)] << (np.uint64(63) - shift) << np.uint64(1)
        found = (self.bits[word] >> shift) | upper
        return np.bitwise_count(found & ~(found + np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, self.before, False) - at).astype(np.uint64)
        return (high << np.uint64(self.width)) | self.lows(at)

    def find(self, keys: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Position of each key, within [first, last) if given; -1 where it is absent."""
        out = np.full(len(keys), -1, np.int64)
        high = keys >> np.uint64(self.width)
        most = int(self.zeros[-1]) - 1
        there = np.flatnonzero(high <= np.uint64(max(most, 0))) if self.size and most >= 0 else np.zeros(0, np.int64)
        if not len(there):
            return out
        h = high[there].astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        ones = self._ones_from(start + h)
        more = np.flatnonzero(ones == 64)
        ones[more] = self._select(h[more], self.zeros, True) - h[more] - start[more]
        after = start + ones
        if first is not None:
            start, after = np.maximum(start, first[there]), np.minimum(after, last[there])
        want = keys[there] & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(start < after)
        while len(live):
            middle = (start[live] + after[live]) >> 1
            low = self.lows(middle)
            out[there[live[low == want[live]]]] = middle[low == want[live]]
            start[live] = np.where(low < want[live], middle + 1, start[live])
            after[live] = np.where(low > want[live], middle, after[live])
            live = live[(start[live] < after[live]) & (low != want[live])]
        return out


def quantise(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (high - low) / QUANTUM or 1.0
    return {
        f"{name}.range": np.array([low, step]),
        f"{name}.code": np.rint((values - low) / step).astype(np.uint16),
    }


def restored(sections: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    low, step = sections[f"{name}.range"]
    return low + sections[f"{name}.code"][at] * step


# --- files of the shared folder -----------------------------------------------------


def pack(sections: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, each on a multiple of eight bytes, after a header."""
    at, index, out = 0, {}, []
    for name, array in sections.items():
        raw = np.ascontiguousarray(array).tobytes()
        index[name] = (str(array.dtype), at, len(raw))
        out.append(raw + b"\0" * (-len(raw) % 8))
        at += len(out[-1])
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(out)


def unpack(buffer) -> dict[str, np.ndarray]:
    size = int.from_bytes(buffer[:8], "little")
    index = json.loads(bytes(buffer[8 : 8 + size]))
    return {
        name: np.frombuffer(buffer, kind, length // np.dtype(kind).itemsize, 8 + size + at)
        for name, (kind, at, length) in index.items()
    }


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, name: str, sections: dict[str, np.ndarray]) -> None:
    """A repeated task writes the same file again; it appears under its name when whole."""
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(pack(sections))
    store.move(own, f"{path}/{name}")


@lru_cache(maxsize=512)
def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The file mapped into memory where the shared folder is mounted; of a store that
    is not, its bytes, as nothing may be written to a worker's own disk."""
    store, path = _place(folder)
    if isinstance(store, pafs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as file:
            return unpack(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    with store.open_input_stream(f"{path}/{name}") as source:
        return unpack(memoryview(source.read()))


# --- training -----------------------------------------------------------------------


#: A-Z lowered, and every separator of words as a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def words_in(column: pa.Array) -> pa.Array:
    """The words of each text of a string column without nulls, A-Z lowered, as a list
    with empty words between neighbouring separators."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    even = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_PLAIN) if data else b""
    even = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(even))
    return pc.split_pattern(even, " ")


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Run:
    """Some texts as word codes: END follows each text, BEGIN has the last code."""

    def __init__(self, column: pa.Array):
        words = words_in(column)
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        given = coded.indices.to_numpy()
        # nothing stands between neighbouring separators, and has the code of END
        end = distinct.index(END) if END in distinct else len(distinct)
        there = np.concatenate(([0], np.cumsum(given != end)))
        self.sizes = np.diff(there[words.offsets.to_numpy()]) + 1
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        inside = np.ones(int(self.sizes.sum()), bool)
        inside[ends - 1] = False
        self.codes = np.full(len(inside), end, np.int64)
        self.codes[inside] = given[given != end]
        distinct += [END][: end + 1 - len(distinct)]
        self.begin = len(distinct)
        self.hashes = hash_words([*distinct, BEGIN])

    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.starts] = self.begin
        return before


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Run]]:
    """First row, number of rows and texts of each run of about RUN_TOKENS words."""
    column = batch.column("text")
    ends, at = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64), 0
    while at < len(column):
        held = ends[at - 1] if at else 0
        stop = min(int(np.searchsorted(ends, held + 7 * RUN_TOKENS)) + 1, len(column))
        yield at, stop - at, Run(column.slice(at, stop - at))
        at = stop


def _count_words(batches: Batches) -> Batches:
    for batch in batches:
        for _, rows, run in runs(batch):
            counts = np.bincount(run.codes, minlength=len(run.hashes))
            counts[run.begin] = rows
            yield batch_of([pa.array(run.hashes.view(np.int64)), pa.array(counts)], ["word", "n"])


def part_of(word: str, bits: int) -> Column:
    return (F.shiftrightunsigned(word, 64 - bits) if bits else F.lit(0)).cast("int")


@dataclass(frozen=True)
class Model:
    """Where the parts are and what was counted; ``offsets`` numbers their words."""

    folder: str
    bits: int
    offsets: tuple[int, ...]
    tokens: int
    words: int

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def by_part(self, hashes: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each part that has words and the places in ``hashes`` that fall into it."""
        parts = self.part(hashes)
        at = np.argsort(parts, kind="stable") if among is None else among[np.argsort(parts[among], kind="stable")]
        parts = parts[at]
        edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True]))) if len(at) else []
        for a, b in zip(edges[:-1], edges[1:]):
            part = int(parts[a])
            if self.offsets[part] < self.offsets[part + 1]:
                yield part, at[a:b]

    def of_contexts(self, pairs: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each part that has contexts of some sorted pairs, and where these are."""
        edges = np.searchsorted(pairs >> np.uint64(32), np.array(self.offsets, np.uint64)).tolist()
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                yield part, slice(a, b)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each word."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for part, at in self.by_part(hashes):
            sections = _mapped(self.folder, f"words-{part}")
            found = Sequence(sections, "word").find(hashes[at])
            known = found >= 0
            number[at[known]] = self.offsets[part] + found[known]
            count[at[known]] = sections["count"][found[known]]
        return number, count

    def single(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of words seen ``counts`` times."""
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


def _write_words(folder: str):
    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        part = key[0].as_py()
        counts = table.column("n").to_numpy()[order]
        _write(folder, f"words-{part}", encode(words[order], "word") | {"count": counts})
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(words)], pa.int64())})

    return write


def _planes(array: np.ndarray) -> bytes:
    return array.view(np.uint8).reshape(len(array), -1).T.tobytes()


def _unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def squeeze(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts, compressed byte by byte."""
    gaps = np.diff(pairs, prepend=np.uint64(0))
    raw = _planes(gaps) + _planes(counts.astype(np.uint64))
    return len(pairs).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def expand(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(block[8:])
    return np.cumsum(_unplanes(raw[: 8 * n], "<u8", n), dtype=np.uint64), _unplanes(raw[8 * n :], "<u8", n)


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their counts."""
    if not len(pairs):
        return pairs, counts
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(counts[order], first)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs of word numbers as one number each."""
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def _count_pairs(model: Model):
    """Rows of ``part`` and a block of pairs: context's place in its part, then word number."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for _, _, run in runs(batch):
                number, _ = model.lookup(run.hashes)
                found, counts = np.unique(joined(number[run.contexts()], number[run.codes]), return_counts=True)
                parts, blocks = [], []
                for part, at in model.of_contexts(found):
                    parts.append(part)
                    own = found[at] - (np.uint64(model.offsets[part]) << np.uint64(32))
                    blocks.append(squeeze(own, counts[at].astype(np.uint64)))
                yield batch_of([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    return count


def _write_pairs(model: Model, discount: float, least: int):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every = [(pairs, counts), *waiting]
            return summed(np.concatenate([p for p, _ in every]), np.concatenate([c for _, c in every]))

        for batch in batches:
            for block in batch.column("block"):
                waiting.append(expand(block.as_py()))
                if sum(len(p) for p, _ in waiting) > max(PART_TOKENS // 4, len(pairs)):
                    pairs, counts = merge()
                    waiting = []
        pairs, counts = merge()

        sections = _mapped(model.folder, f"words-{part}")
        words = len(sections["count"])
        often = counts >= least
        pairs, counts = pairs[often], counts[often].astype(float)
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        total = np.maximum(sections["count"], 1)
        kept = (counts - discount) / total[context]
        left = 1 - np.bincount(context, kept, words)
        # a word's own count for the lower level comes from the first level of its part
        own = np.zeros(len(word))
        offsets = np.array(model.offsets)
        home = np.searchsorted(offsets, word, "right") - 1
        for other in np.unique(home):
            at = np.flatnonzero(home == other)
            own[at] = _mapped(model.folder, f"words-{other}")["count"][word[at] - offsets[other]]
        probability = np.log10(kept + left[context] * 10 ** model.single(own))
        pointers = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=words))))
        # successors relative to the last successor of the context before
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(word) else np.zeros(0, np.int64)
        ends = np.concatenate((first[1:], [len(word)])) - 1 if len(word) else first
        bases = np.concatenate(([0], np.cumsum(word[ends] + 1)[:-1])) if len(word) else first
        runs_of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(word)]))))
        successors = (word + (bases[runs_of] if len(word) else 0)).astype(np.uint64)
        _write(
            model.folder,
            f"pairs-{part}",
            encode(pointers.astype(np.uint64), "pointer")
            | encode(successors, "successor")
            | quantise(probability, "probability")
            | quantise(np.log10(np.maximum(left, 1e-12)), "rest"),
        )
        yield batch_of([pa.array([part], pa.int32()), pa.array([len(word)], pa.int64())], ["part", "n"])

    return write


def train(docs: DataFrame, discount: float = DISCOUNT, least: int = LEAST_PAIR) -> Model:
    """Counts all texts of ``docs`` and writes the model; a null text is an empty one.

    Words are split at white space with A-Z lowered; one end follows each text. An
    empty table gives a model that knows nothing. A model has fewer than 2 ** 32
    distinct words.
    """
    plain = texts(docs).select("text")
    counts = mapped(plain, _count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    begin = int(hash_words([BEGIN]).view(np.int64)[0])
    row = counts.filter(F.col("word") != begin).agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, words = int(row[0] or 0), int(row[1])
    if words >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words")
    bits = max(0, (tokens // PART_TOKENS).bit_length())
    folder = f"{scratch_path(docs.sparkSession)}-model"
    parted = counts.withColumn("part", part_of("word", bits)).groupBy("part")
    sizes = {r["part"]: r["n"] for r in parted.applyInArrow(_write_words(folder), "part int, n long").collect()}
    offsets = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(1 << bits)])))
    model = Model(folder, bits, tuple(offsets.tolist()), tokens, words)
    blocks = mapped(plain, _count_pairs(model), "part int, block binary").groupBy("part")
    blocks.applyInArrow(_write_pairs(model, discount, least), "part int, n long").collect()
    return model


# --- scoring ------------------------------------------------------------------------


class Successors:
    """The second level of one part."""

    def __init__(self, sections: dict[str, np.ndarray]):
        self.sections = sections
        self.pointer, self.successor = Sequence(sections, "pointer"), Sequence(sections, "successor")

    def ranges(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the successors of a context begin and end, and what they are relative to."""
        first, last = self.pointer.get(place).astype(np.int64), self.pointer.get(place + 1).astype(np.int64)
        base = np.zeros(len(place), np.uint64)
        some = (first > 0) & (first < last)
        base[some] = self.successor.get(first[some] - 1) + np.uint64(1)
        return first, last, base

    def probabilities(self, pairs: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of some sorted pairs of context's place and
        word number; NaN where the model has no such pair."""
        context, word = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
        new = np.concatenate(([True], context[1:] != context[:-1]))
        own = np.cumsum(new) - 1
        first, last, base = self.ranges(context[new])
        at = self.successor.find(base[own] + word, first[own], last[own])
        out = np.full(len(pairs), np.nan)
        out[at >= 0] = restored(self.sections, "probability", at[at >= 0])
        return out


def score_run(model: Model, run: Run) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text of a run."""
    number, count = model.lookup(run.hashes)
    single = model.single(count)
    rest = np.zeros(len(number))
    place = number - np.array(model.offsets)[model.part(run.hashes)]
    for part, at in model.by_part(run.hashes, np.flatnonzero(number >= 0)):
        rest[at] = restored(_mapped(model.folder, f"pairs-{part}"), "rest", place[at])
    before = run.contexts()
    value = rest[before] + single[run.codes]
    known = number >= 0
    ask = np.flatnonzero(known[before] & known[run.codes])
    # each pair is asked for once, in the order in which the files have them
    pairs = joined(number[before[ask]], number[run.codes[ask]])
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]
    pairs, times = pairs[first], np.cumsum(first) - 1
    found = np.full(len(pairs), np.nan)
    for part, at in model.of_contexts(pairs):
        level = Successors(_mapped(model.folder, f"pairs-{part}"))
        found[at] = level.probabilities(pairs[at] - (np.uint64(model.offsets[part]) << np.uint64(32)))
    hit = ~np.isnan(found)[times]
    value[ask[order[hit]]] = found[times[hit]]
    sums = lambda x: np.add.reduceat(x, run.starts)
    return run.sizes, sums((count[run.codes] > 0).astype(np.int64)), sums(single[run.codes]), sums(value)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` of every row.

    ``score`` is the log10 probability of the text with its end under the model,
    ``base_score`` the same by single words with one added to each count. A null or
    empty text is its end alone; rows may repeat; an empty table gives none.
    """
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, rows, some in runs(batch):
                columns = [pa.array(x) for x in score_run(model, some)]
                yield batch_of([batch.column("doc_id").slice(at, rows), *columns], names)

    return mapped(texts(docs), run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
