"""Two tokenizers aligned over a corpus by the places where their tokens end together.

Every text is encoded whole by both. Places where a token of either begins with a space
and the token before ends, in both, are anchors; they cut a document into windows of
token ids. Windows repeat as words do, so the alignment of a window is found once for
its two id tuples and kept. Where all white space of a text that touches a space is that
space alone, the windows are the chunks between its spaces, and the tokens and the
alignment of a chunk are found once and kept together. A link is a pair of tokens that end together; links are
counted over the corpus, and each document is told how its links fare.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .bpe import slices
from .common import Batches, batch_of, mapped, texts

#: The same ids as byte_bpe_50k.json without its special token, from the rank file.
FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of windows and of chunks that a worker keeps, and characters of the texts that it aligns, and
#: links that it looks up, together.
HELD, RUN = 64 << 20, 1 << 20
#: Bytes of chunks that a worker keeps with the alignment of their tokens.
ALIGNED = 128 << 20
#: Pairs that the tasks may hold at once (16 bytes each); more are joined.
MOST_PAIRS = 4_000_000
_SPACE_MARK = "▁"
#: A space before white space, which the first tokenizer may join with what comes before.
_wide = re.compile(r" \s").search


# --- tokens -------------------------------------------------------------------------


class Side:
    """Byte strings of the ids of a tokenizer."""

    def __init__(self, tokens: list[bytes], end: str):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)
        #: What is written of an id inside a group and at its end.
        self.shown = [f"{i}{mark}".encode() for i in range(len(tokens)) for mark in (",", end)]

    def starts(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Both:
    """The two tokenizers, and the windows met so far with their alignment."""

    def __init__(self, first: str, second: str):
        ranks = _ranks(first)
        self.bytes_model = tiktoken.Encoding(
            "first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.a = Side(sorted(ranks, key=ranks.get), "|")
        self.piece_model = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.piece_model.id_to_piece(i) for i in range(self.piece_model.vocab_size())]
        self.b = Side(
            [
                bytes([int(p[3:5], 16)]) if self.piece_model.is_byte(i) else p.replace(_SPACE_MARK, " ").encode()
                for i, p in enumerate(pieces)
            ],
            ";",
        )
        self.shown = self.a.shown + self.b.shown
        # a text may be cut before a space where no piece reaches over it
        self.cuts = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces)
        self.known: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.held = self.chunks_held = 0
        #: Numbers of tokens, groups and links of a chunk; none where it has no tokens.
        self.aligned: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        self.aligned_held = 0

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Pieces of chunks, each as if a space came before it; none where they do not
        give it back byte by byte."""
        ids = self.piece_model.encode(chunks, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), "<u2")
        ends = np.cumsum([len(i) for i in ids])
        wanted = [b" " + chunk.encode() for chunk in chunks]
        found = b"".join(map(self.b.tokens.__getitem__, flat.tolist()))
        stops = np.concatenate([[0], np.cumsum(self.b.sizes[flat])])[ends]
        good = found == b"".join(wanted) and stops.tolist() == np.cumsum([len(w) for w in wanted]).tolist()
        raw, at = flat.tobytes(), 0
        for chunk, want, end, stop in zip(chunks, wanted, (ends * 2).tolist(), stops.tolist()):
            same = good or found[stop - int(self.b.sizes[flat[at // 2 : end // 2]].sum()) : stop] == want
            self.chunks[chunk] = raw[at:end] if same else None
            self.chunks_held += 250 + len(want) + end - at
            at = end

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text, of all of it; none where the bytes differ from it.

        No piece reaches from another character into a space, so pieces are found in the
        chunks between single spaces alone, each chunk once. Texts with neighbouring
        spaces are one chunk.
        """
        plain = lambda t: self.cuts and "  " not in t and t[0] != " " and t[-1] != " "
        chunks = [(t.split(" ") if plain(t) else [t]) if t else [] for t in texts]
        every = set().union(*chunks)
        missing = every.difference(self.chunks)
        if missing and self.chunks_held > HELD:
            self.chunks.clear()
            self.chunks_held, missing = 0, every
        if missing:
            self._learn_chunks(list(missing))
        out = []
        for text, own in zip(texts, chunks):
            found = list(map(self.chunks.__getitem__, own))
            first = second = np.zeros(0, "<u2")
            if found and None not in found:
                second = np.frombuffer(b"".join(found), "<u2")
                parts = slices(" " + text) if self.cuts else [" " + text]
                ids = [self.bytes_model.encode_to_numpy(part, disallowed_special=()) for part in parts]
                first = np.concatenate(ids).astype("<u2")
                # ids of bytes cut the bytes they are given, so their number tells
                if int(self.a.sizes[first].sum()) != int(self.b.sizes[second].sum()):
                    first = second = np.zeros(0, "<u2")
            out.append((first, second))
        return out

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The id tuples between anchors, as bytes."""
        at, bt = self.a.starts(a), self.b.starts(b)
        begins = np.full(int(at[-1]) + 1, -1, np.int32)
        spaced = np.flatnonzero(self.a.spaced[a])
        begins[at[spaced]] = spaced
        mine = np.flatnonzero(self.b.spaced[b])
        mine = mine[bt[mine] <= at[-1]]
        theirs = begins[bt[mine]]
        mine, theirs = mine[theirs > 0], theirs[theirs > 0]
        left, right = [0, *(theirs * 2).tolist(), 2 * len(a)], [0, *(mine * 2).tolist(), 2 * len(b)]
        x, y = a.tobytes(), b.tobytes()
        return [(x[i:j], y[k:n]) for i, j, k, n in zip(left, left[1:], right, right[1:])]

    def _align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """The groups and links of some windows, found all at once.

        The byte strings of a window are equal on both sides, so those of all windows
        one after another are, and a place where tokens of both end is found by marking
        the ends of one side and looking up those of the other.
        """
        a, b = (np.frombuffer(b"".join([w[side] for w in windows]), "<u2") for side in (0, 1))
        ends, other = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        marked = np.zeros(int(ends[-1]) + 1, bool)
        marked[ends] = True
        last_b = marked[other]
        marked[:] = False
        marked[other] = True
        last_a = marked[ends]
        links = a[last_a].astype("<u4") << 16 | b[last_b]
        # tokens in the order of groups, the first side before the second in each
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        codes = np.concatenate([a * np.int64(2) + last_a, len(self.a.shown) + b * np.int64(2) + last_b])[order]
        pieces = list(map(self.shown.__getitem__, codes.tolist()))
        sizes = [np.array([len(w[side]) // 2 for w in windows]) for side in (0, 1)]
        cuts = [0, *np.cumsum(sizes[0] + sizes[1]).tolist()]
        counts = np.add.reduceat(last_a.astype(np.int64), np.cumsum(sizes[0]) - sizes[0])
        raw, at = links.tobytes(), [0, *(np.cumsum(counts) * 4).tolist()]
        return [(b"".join(pieces[i:j]), raw[k:n]) for i, j, k, n in zip(cuts, cuts[1:], at, at[1:])]

    def _learn(self, windows: list[tuple[bytes, bytes]]) -> None:
        """Align windows that are not known and keep them."""
        for window, found in zip(windows, self._align(windows)):
            self.held += 330 + len(window[0]) + len(window[1]) + len(found[0]) + len(found[1])
            self.known[window] = found

    def align_all(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[bytes, bytes]]:
        """The groups of each document as text, and its links: the first id times 2**16
        plus the second, little-endian unsigned 32-bit."""
        windows = [self.windows(a, b) if len(a) else [] for a, b in ids]
        if self.held > HELD:
            self.known.clear()
            self.held = 0
        found = [list(map(self.known.get, own)) for own in windows]
        missing = {w for own, its in zip(windows, found) if None in its for w, f in zip(own, its) if f is None}
        if missing:
            self._learn(list(missing))
        out = []
        for own, its in zip(windows, found):
            if None in its:
                its = [f or self.known[w] for w, f in zip(own, its)]
            # every group ends with a semicolon; the last one of a document does not
            out.append((b"".join([f[0] for f in its])[:-1], b"".join([f[1] for f in its])))
        return out


    def _learn_aligned(self, chunks: list[str]) -> None:
        """Tokens and alignment of chunks, each as if a space came before it.

        A chunk does not begin with white space, so no match of the first tokenizer
        reaches from one into the next, and all are encoded as one text.
        """
        ids = self.piece_model.encode(chunks, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), "<u2")
        ends_b = np.cumsum([len(i) for i in ids])
        wanted = [b" " + chunk.encode() for chunk in chunks]
        whole, found = b"".join(wanted), b"".join(map(self.b.tokens.__getitem__, flat.tolist()))
        stops = np.concatenate([[0], np.cumsum(self.b.sizes[flat])])[ends_b]
        ends = np.cumsum([len(w) for w in wanted])
        same = [True] * len(chunks)
        if found != whole or stops.tolist() != ends.tolist():
            begins = [0, *stops.tolist()]
            same = [found[i:j] == want for i, j, want in zip(begins, begins[1:], wanted)]
        first = self.bytes_model.encode_to_numpy(whole.decode(), disallowed_special=()).astype("<u2")
        ends_a = np.searchsorted(np.cumsum(self.a.sizes[first]), ends) + 1
        x, y = first.tobytes(), flat.tobytes()
        left, right = [0, *(ends_a * 2).tolist()], [0, *(ends_b * 2).tolist()]
        windows = [(x[i:j], y[k:n]) if ok else None for i, j, k, n, ok in zip(left, left[1:], right, right[1:], same)]
        its = iter(self._align([w for w in windows if w])) if any(same) else iter(())
        for chunk, want, window in zip(chunks, wanted, windows):
            groups, links = next(its) if window else (b"", b"")
            self.aligned[chunk] = (len(window[0]) // 2, len(window[1]) // 2, groups, links) if window else None
            self.aligned_held += 360 + len(want) + len(groups) + len(links)

    def align_texts(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes]]:
        """The number of tokens of each side, the groups as text and the links of each
        text, as ``encode`` and ``align_all`` give them."""
        plain = [bool(self.cuts and t and not t[0].isspace() and t[-1] != " " and not _wide(t)) for t in texts]
        chunks = [t.split(" ") if p else [] for t, p in zip(texts, plain)]
        every = set().union(*chunks)
        missing = every.difference(self.aligned)
        if missing and self.aligned_held > ALIGNED:
            self.aligned.clear()
            self.aligned_held, missing = 0, every
        if missing:
            self._learn_aligned(list(missing))
        ids = self.encode([t for t, p in zip(texts, plain) if not p])
        others = ((len(a), len(b), *own) for (a, b), own in zip(ids, self.align_all(ids)))
        out = []
        for p, own in zip(plain, chunks):
            found = list(map(self.aligned.__getitem__, own))
            if not p:
                out.append(next(others))
            elif None in found:
                out.append((0, 0, b"", b""))
            else:
                a, b, groups, links = zip(*found)
                # every group ends with a semicolon; the last one of a document does not
                out.append((sum(a), sum(b), b"".join(groups)[:-1], b"".join(links)))
        return out


@lru_cache(maxsize=1)
def both(first: str, second: str) -> Both:
    """One pair of tokenizers for each worker."""
    return Both(first, second)


def _runs(given: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``RUN`` characters together."""
    some, held = [], 0
    for text in given:
        some.append(text)
        held += len(text)
        if held > RUN:
            yield some
            some, held = [], 0
    yield some


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, with_groups: bool = False) -> DataFrame:
    """``row`` (a number of its own, new in every run), ``doc_id``, ``n_a``, ``n_b``,
    ``links`` (binary, one unsigned 32-bit number a link: the first id times 65,536 plus
    the second) and ``groups_sha256`` of every row; on request also ``groups``, the
    text `a1,a2|b1;a3|b2,b3`.

    A null or empty text, and one that either tokenizer does not give back byte by byte,
    has no tokens: zeros, no links, an empty hash. Rows may repeat; an empty table gives
    none; other columns are not looked at. The files must exist on the workers.
    """
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    schema = "row long, doc_id long, n_a long, n_b long, links binary, groups_sha256 string" + ", groups string" * with_groups
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        pair, row = both(first, second), TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, links, hashes, groups = [], [], [], []
            for some in _runs(batch.column("text").to_pylist()):
                for n_a, n_b, listed, own in pair.align_texts(some):
                    counts.append((n_a, n_b))
                    links.append(own)
                    hashes.append(hashlib.sha256(listed).hexdigest() if n_a else "")
                    if with_groups:
                        groups.append(listed.decode())
            sizes = np.array(counts, np.int64).reshape(-1, 2)
            columns = [
                pa.array(np.arange(row, row + len(sizes))), batch.column("doc_id"), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]),
                pa.array(links, pa.binary()), pa.array(hashes, pa.string()),
            ]
            row += len(sizes)
            yield batch_of(columns + [pa.array(groups, pa.string())] * with_groups, names)

    return mapped(texts(docs), run, schema)


# --- counts -------------------------------------------------------------------------


def _links_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time, their links, and where the links of each row end."""
    sizes = pc.binary_length(batch.column("links")).to_numpy().astype(np.int64) // 4
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        rows = batch.slice(at, max(int(np.searchsorted(ends, before + RUN, "right")) - at, 1))
        links = np.frombuffer(b"".join(rows.column("links").to_pylist()), "<u4")
        yield rows, links, ends[at : at + len(rows)] - before
        at += len(rows)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pair, np.bincount(back, np.concatenate([n for _, n in parts]), len(pair)).astype(np.int64)


def _count_links(batches: Batches) -> Batches:
    parts, held = [], 0
    for _, own, _ in (run for batch in batches for run in _links_of(batch)):
        parts.append(np.unique(own, return_counts=True))
        held += len(parts[-1][0])
        if held > MOST_PAIRS:
            parts = [_merged(parts)]
            held = len(parts[0][0])
            if held > MOST_PAIRS // 2:
                yield batch_of([pa.array(parts[0][0], pa.int64()), pa.array(parts[0][1], pa.int64())], ["pair", "n"])
                parts, held = [], 0
    if parts:
        pair, n = _merged(parts)
        yield batch_of([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])


def link_counts(found: DataFrame) -> DataFrame:
    """``pair``, ``n`` over the corpus and ``best``, whether no other pair of its second
    id has more links."""
    counts = mapped(found.select("links"), _count_links, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    second = F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("second")
    most = counts.groupBy(second).agg(F.max("n").alias("most"))
    return counts.select("*", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_FATE = "n_best long, count_sum long"


def _with_held(spark: SparkSession, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Figures of each row by a table of pairs that every task holds."""
    table = counts.toArrow().sort_by("pair")
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    given = spark.sparkContext.broadcast((pair.astype("<u4"), n, best))
    names = [*found.columns, "n_best", "count_sum"]

    def run(batches: Batches) -> Batches:
        pair, n, best = given.value
        for rows, links, ends in (run for batch in batches for run in _links_of(batch)):
            at = np.searchsorted(pair, links)
            ends = np.concatenate([[0], ends])
            summed = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])
            yield batch_of([*rows.columns, pa.array(summed(best[at])), pa.array(summed(n[at]))], names)

    kinds = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return mapped(found, run, f"{kinds}, {_FATE}")


def _own_pairs(batches: Batches) -> Batches:
    for batch in batches:
        for row, links in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist()):
            pair, times = np.unique(np.frombuffer(links, "<u4"), return_counts=True)
            if len(pair):
                yield batch_of([pa.array([row] * len(pair)), pa.array(pair, pa.int64()), pa.array(times, pa.int64())], ["row", "pair", "times"])


def _with_joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same figures by a join, for any number of pairs."""
    own = mapped(found.select("row", "links"), _own_pairs, "row long, pair long, times long").join(counts, "pair")
    figures = own.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    return found.join(figures, "row", "left").fillna(0, ["n_best", "count_sum"])


def align_corpus(docs: DataFrame, first: str | None = None, second: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose pair has the most links of
    its second id, ties included) and ``count_sum`` (the counts of the links' pairs).

    Counts are over all documents. Where they are more than ``most_pairs`` pairs they
    are joined instead of being held by the tasks; the figures are the same.
    """
    found = cut_lineage(aligned(docs, first, second))
    counts = cut_lineage(link_counts(found))
    few = counts.count() <= most_pairs
    judged = _with_held(docs.sparkSession, found, counts) if few else _with_joined(found, counts)
    return judged.withColumn("n_links", (F.length("links") / 4).cast("long"))
