"""A toxicity classifier with a counterfactual penalty on identity terms.

Features are hashes of the distinct words of a text and of their beginnings; which
of them count is decided by how far their share of toxic texts departs from chance.
The weights are logistic, with classes balanced, and every labelled text that names
a group is also read with the names exchanged: the squared change of its score is
part of the loss, so a group's name cannot carry weight of its own.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Batches, batch_of, fresh, kept_by_worker, mapped, remainder, slices, table, texts

#: Rows of labels that a fit uses at most, the first by a hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Texts a feature must be in, and standard deviations its toxic share must depart.
LEAST_TEXTS, DEPARTURE = 4, 4.0
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS, RATE, SHRINK, COUNTERFACTUAL = 200, 0.05, 1e-5, 1.0
REJECT = 0.7
#: The bias where no labelled text is found.
NOTHING = -20.0
#: Words whose weights or features a worker keeps.
HELD = 100_000

#: Names of groups; a name is exchanged for the next of its line.
IDENTITIES = (
    "christian muslim jewish hindu buddhist atheist",
    "christians muslims jews hindus buddhists atheists",
    "woman man",
    "women men",
    "girl boy",
    "gay straight lesbian bisexual transgender",
    "black white asian latino arab african",
    "american mexican chinese german french russian indian turkish",
    "deaf blind disabled",
    "young old",
    "immigrant native refugee",
    "immigrants natives refugees",
    "frauen männer",
    "christen muslime juden",
    "femmes hommes",
    "chrétiens musulmans juifs",
    "mujeres hombres",
    "cristianos musulmanes judíos",
)
_words = re.compile(r"[^\W\d_]+").findall


def exchanges(lines: tuple[str, ...] = IDENTITIES) -> dict[str, str]:
    named = [line.split() for line in lines]
    return {a: b for names in named for a, b in zip(names, names[1:] + names[:1])}


def distinct_words(text: str) -> set[str]:
    found: set[str] = set()
    for part in slices(text.lower()):
        found.update(_words(part))
    return found


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    raw = word.encode()
    return (
        zlib.crc32(b"=" + raw),
        *[zlib.crc32(b"%d" % n + word[:n].encode()) for n in BEGINNINGS if n < len(word)],
    )


_features = lru_cache(HELD)(features)
kept_by_worker(_features.cache_clear)


def counted(words: set[str]) -> dict[int, int]:
    """How many of the words have each feature."""
    out: dict[int, int] = {}
    for word in words:
        for f in _features(word):
            out[f] = out.get(f, 0) + 1
    return out


def _count(batches: Batches) -> Batches:
    for batch in batches:
        held: dict[int, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for f in counted(distinct_words(text)):
                pair = held.setdefault(f, [0, 0])
                pair[0] += 1
                pair[1] += toxic
        values = np.array(list(held.values()), np.int64).reshape(-1, 2)
        columns = [pa.array(list(held), pa.int64()), pa.array(values[:, 0]), pa.array(values[:, 1])]
        yield batch_of(columns, ["feature", "n", "toxic"])


def _vectors(chosen: dict[int, int], swap: dict[str, str]):
    """Chosen features of each text, and of the text with names exchanged, if any."""

    def vector(words: set[str]) -> tuple[list[int], list[int]]:
        found = {chosen[f]: n for f, n in counted(words).items() if f in chosen}
        return list(found), list(found.values())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = distinct_words(text)
                other = {swap.get(w, w) for w in words}
                rows.append((toxic, *vector(words), *(vector(other) if other != words else (None, None))))
            if rows:
                kinds = [pa.int32(), *[pa.list_(pa.int32())] * 4]
                names = ["toxic", "at", "n", "other_at", "other_n"]
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


@dataclass(frozen=True)
class Model:
    """``score = 1 / (1 + exp(-(bias + sum of weights)))`` over the distinct words."""

    weights: dict[int, float]
    bias: float

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def score(self, text: str) -> float:
        return _share(self.bias + sum(map(self.word, distinct_words(text))))


def _share(value: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(value, -500, 500))))


def _sparse(at: list[list[int]], n: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(x) for x in at]
    flat = lambda rows: np.array([v for row in rows for v in row], np.int64)
    return np.repeat(np.arange(len(at)), sizes), flat(at), flat(n).astype(float)


def fit_weights(rows: list, size: int, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias for ``rows`` of (toxic, at, n, other_at, other_n), by Adam."""
    label = np.array([r[0] for r in rows], float)
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    row, at, n = _sparse([r[1] for r in rows], [r[2] for r in rows])
    # the change of a swapped text as one signed vector
    pairs = [r for r in rows if r[3] is not None]
    row_a, at_a, n_a = _sparse([r[1] for r in pairs], [r[2] for r in pairs])
    row_b, at_b, n_b = _sparse([r[3] for r in pairs], [r[4] for r in pairs])
    drow, dat, dn = np.concatenate((row_a, row_b)), np.concatenate((at_a, at_b)), np.concatenate((n_a, -n_b))
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the bias is last
    for step in range(1, STEPS + 1):
        value = w[-1] + np.bincount(row, w[at] * n, len(rows))
        gap = (1 / (1 + np.exp(-np.clip(value, -500, 500))) - label) * weight
        slope = np.append(np.bincount(at, gap[row] * n, size) + SHRINK * w[:-1], gap.sum())
        if len(pairs):
            change = np.bincount(drow, w[dat] * dn, len(pairs))
            slope[:-1] += penalty * 2 / len(pairs) * np.bincount(dat, change[drow] * dn, size)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    identities: tuple[str, ...] = IDENTITIES,
    penalty: float = COUNTERFACTUAL,
) -> Model:
    """Learns ``labels.toxic`` from the texts of at most ``sample_rows`` labelled rows.

    A doc_id labelled twice counts as toxic if half its labels are. Null labels and
    null ids are left out, null texts are empty. With no label, or labels of one kind
    only, all texts get the share of toxic labels, or 0.
    """
    given = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    given = given.agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows short rows
    sample = texts(docs).join(F.broadcast(given), "doc_id").select("text", "toxic")
    # labels without a text teach nothing, so the labelled texts are counted
    rows, positive = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    positive = int(positive or 0)
    if positive in (0, rows):
        # one kind alone says nothing against a text, so the odds are even at most
        return Model({}, float(min(np.log((positive + 1) / (rows - positive + 1)), 0.0)) if rows else NOTHING)
    share = positive / rows
    found = mapped(sample, _count, "feature long, n long, toxic long").groupBy("feature")
    found = found.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_TEXTS)
    away = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    # features of a bounded sample that pass a strict test: some thousands
    names = sorted(r[0] for r in found.filter(F.abs(away) >= DEPARTURE).select("feature").collect())
    chosen = {f: i for i, f in enumerate(names)}
    kind = "toxic int, at array<int>, n array<int>, other_at array<int>, other_n array<int>"
    vectors = [tuple(r) for r in mapped(sample, _vectors(chosen, exchanges(identities)), kind).collect()]
    weights, bias = fit_weights(vectors, len(names), penalty) if vectors else (np.zeros(len(names)), 0.0)
    return Model(dict(zip(names, weights.tolist())), bias)


def score_texts(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text, from 0 to 1.

    Only ``text`` is read; a null text scores like an empty one, by the bias. Rows
    may repeat, an empty table gives none; ``name`` gets underscores where taken.
    """
    name = fresh(docs, name)

    def run(batches: Batches) -> Batches:
        value = lru_cache(HELD)(model.word)
        for batch in batches:
            content = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = [_share(model.bias + sum(map(value, distinct_words(t or "")))) for t in content]
            yield batch_of([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return mapped(docs, run, T.StructType([*docs.schema.fields]).add(name, T.DoubleType()))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labels of a folder, without the held-out third."""
    labels = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    return fit(docs, labels)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: rows that score at least 0.7 go, all others stay as they are."""
    name = fresh(docs, "toxicity")
    found = score_texts(docs, trained(spark, docs, sf_dir), name)
    return found.filter(F.col(name) < REJECT).drop(name)
