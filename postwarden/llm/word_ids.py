"""Token ids of whole texts by a word tokenizer, found once for each distinct word.

The tokenizer drops white space and never joins what white space parts, so the ids of
a text are those of its words in order. Texts of a batch are cut into words and the
words numbered by Arrow; Python sees each distinct word of a run once, and numpy puts
the ids of the texts together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import kept_by_worker

#: A task has one core; threads of the tokenizer would take the others from other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of words and ids that a worker keeps, and of texts whose words it holds at once.
HELD, RUN_BYTES = 256 << 20, 8 << 20
#: Words given to the tokenizer as one text.
JOINED = 2000
#: Letters whose lower and composed forms are letters again.
_letters = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
#: Every separator of words as a space.
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: Texts with these stay as they are: marks that compose with small letters only, and
#: the beginning of a special token, which is one only in its own case.
_KEEP_CASE = "̀|[́-ͯ]|<\\|"


def lowered(column: pa.Array) -> pa.Array:
    """A-Z lowered, as the tokenizer does later, so that fewer words are distinct."""
    keep = pc.match_substring_regex(column, _KEEP_CASE)
    return pc.if_else(keep, column, pc.ascii_lower(column))


def words_in(column: pa.Array) -> pa.Array:
    """The words ``[^\x20\x09-\x0D]+`` of each text of a large string column without
    nulls, as a list with empty words between neighbouring separators."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    spaced = data.to_pybytes()[offsets[0] : offsets[-1]].translate(_SPACES) if data else b""
    even = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(spaced))
    return pc.split_pattern(lowered(even), " ")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every (start, size) one after another, in the
    type of ``starts``."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, starts.dtype)
    return np.arange(ends[-1], dtype=starts.dtype) + np.repeat((starts - ends + sizes).astype(starts.dtype), sizes)


class WordIds:
    """A store of words and their ids, emptied and filled again when it grows too large."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.ends = np.zeros(self.size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self._empty()

    def _empty(self) -> None:
        # the empty word between neighbouring separators has no ids
        self.number: dict[bytes, int] = {b"": 0}
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.held = 0

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.number)
        while len(self.sizes) < first + len(words):
            self.starts, self.sizes = np.concatenate([self.starts] * 2), np.concatenate([self.sizes] * 2)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(words, range(first, first + len(words))))
        self.used += len(ids)
        self.held += 190 * len(words) + sum(map(len, words)) + 4 * len(ids)

    def _encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for own in ids for i in own], self.kind), np.array([len(i) for i in ids], np.int64)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are one match each, and the last id of a match ends it."""
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        # a letter whose lower case is no letter makes more matches than words
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._encode_all(words)

    def _learn(self, words: list[bytes]) -> None:
        letters, mixed, ended, known = {}, {}, [], self.number
        for word in words:
            text = word.decode()
            if _letters(text):
                letters[text] = word
            elif text[-1] in ",." and _letters(text, 0, len(text) - 1):
                ended.append(word)
                if word[:-1] not in known:
                    letters[text[:-1]] = word[:-1]
            else:
                mixed[text] = word
        if ended:
            mixed |= {c: c.encode() for c in ",." if c.encode() not in known}
        for group, encode in ((letters, self._encode_letters), (mixed, self._encode_all)):
            texts = list(group)
            for at in range(0, len(texts), JOINED):
                some = texts[at : at + JOINED]
                self._add([group[t] for t in some], *encode(some))
        if ended:
            both = np.array([[known[w[:-1]], known[w[-1:]]] for w in ended])
            self._add(ended, self.flat[self._places(both.ravel())], self.sizes[both].sum(1))

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        return ragged(self.starts[numbers], self.sizes[numbers])

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of some distinct words."""
        found = list(map(self.number.get, words))
        if None in found:
            if self.held > HELD:
                self._empty()
                found = list(map(self.number.get, words))
            places = [i for i, n in enumerate(found) if n is None]
            missing = [words[i] for i in places]
            self._learn(missing)
            for i, n in zip(places, map(self.number.__getitem__, missing)):
                found[i] = n
        return np.array(found, np.int64)

    def _run(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts in a row, and the number of ids of each."""
        words = words_in(column)
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        own = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = own[np.asarray(coded.indices)]
        sizes = self.sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(np.asarray(pc.list_value_length(words)))]
        return self.flat[ragged(self.starts[numbers], sizes)], np.diff(ends, prepend=0)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column, some texts at a time; nulls are empty."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(column):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right"))
            some = column.slice(at, max(stop - at, 1))
            ids, counts = self._run(pc.fill_null(some.cast(pa.large_string()), ""))
            at += len(some)
            yield from np.split(ids, np.cumsum(counts)[:-1])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store for each worker and tokenizer file."""
    return WordIds(path)


kept_by_worker(word_ids.cache_clear)
