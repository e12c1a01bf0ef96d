"""A quality classifier learned from heuristic labellers alone.

Each labeller votes a text good (1), bad (0) or abstains (-1) by one surface
statistic; some do not judge short texts at all (2). The patterns of votes of all texts are counted, and expectation
maximisation over the counts estimates how often each labeller votes what on good
and on bad texts, and with it the posterior of each pattern; labellers are taken as
independent within a class. The posteriors of a bounded sample are the targets of a
logistic scorer on hashed features, which then scores every text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Batches, batch_of, fresh, mapped, texts, words_of

#: Texts whose posteriors the scorer is fitted to, the first by a hash of their id.
SAMPLE_ROWS = 20_000
ROUNDS, PRIOR, AGREEMENT, SMOOTHING, BETTER = 200, 0.8, 0.7, 1.0, 3.0
BUCKETS, STEPS, RATE, SHRINK = 1 << 12, 300, 0.05, 1e-4
KEEP = 0.5
HELD = 100_000
_SYMBOLS, _CAPITALS, _LETTERS, _DIGITS = (
    b"#$%&*<>{}[]\\^~=_@|",
    bytes(range(65, 91)),
    bytes([*range(65, 91), *range(97, 123)]),
    bytes(range(48, 58)),
)

#: Statistics of a text, and for each labeller: its statistic, and the ranges (low,
#: high) in which it votes bad and good.
STATISTICS = ("words", "symbols", "capitals", "digits", "again", "distinct", "lines", "short", "stops", "shouts", "bars", "length")
#: A labeller that looks for a defect abstains where it finds none, and those of the
#: last group do not judge texts of fewer than FEW words.
_NEVER = (2.0, 1.0)
LABELLERS = (
    ("symbols", (0.04, 9.0), _NEVER),
    ("capitals", (0.6, 9.0), _NEVER),
    ("digits", (0.15, 9.0), _NEVER),
    ("again", (0.2, 9.0), _NEVER),
    ("lines", (0.5, 9.0), _NEVER),
    ("shouts", (0.05, 9.0), _NEVER),
    ("bars", (0.05, 9.0), _NEVER),
    ("distinct", (-1.0, 0.5), (1.3, 9.0)),
    ("short", (-1.0, 0.12), (0.22, 0.45)),
    ("stops", (-1.0, 0.01), (0.045, 0.2)),
    ("length", (6.8, 1e9), (4.4, 6.2)),
)
FEW, FEW_FROM = 20, 7


_SIGNS = {0: "0", 1: "1", -1: "-", 2: "."}  # a dot where the text is too short for the labeller


def _without(text: bytes, gone: bytes) -> int:
    return len(text) - len(text.translate(None, gone))


def statistics(text: bytes) -> tuple[float, ...]:
    """The STATISTICS of a whole text; shares are of its words, characters, letters or lines."""
    words = words_of(text)
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size, letters = len(text), max(_without(text, _LETTERS), 1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.splitlines() if line.strip()]
    return (
        float(n),
        _without(text, _SYMBOLS) / size,
        _without(text, _CAPITALS) / letters,
        _without(text, _DIGITS) / size,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n ** 0.8,  # longer texts repeat more of their words
        1 - len(set(lines)) / len(lines),
        float((sizes <= 3).mean()),
        (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / n,
        text.count(b"!!") / n,
        text.count(b" | ") / n,
        float(sizes.mean()),
    )


def votes(values: tuple[float, ...]) -> tuple[int, ...]:
    out = []
    for place, (name, bad, good) in enumerate(LABELLERS):
        x = values[STATISTICS.index(name)]
        if place >= FEW_FROM and values[0] < FEW:
            out.append(2)
            continue
        out.append(0 if bad[0] < x < bad[1] else 1 if good[0] < x < good[1] else -1)
    return tuple(out)


def _pattern(found: tuple[int, ...]) -> str:
    return "".join(_SIGNS[v] for v in found)


def _count_patterns(batches: Batches) -> Batches:
    for batch in batches:
        held: dict[str, int] = {}
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            key = _pattern(votes(statistics(text)))
            held[key] = held.get(key, 0) + 1
        yield batch_of([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pattern", "n"])


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of good texts and, by labeller, how often it votes bad, good or
    abstains on bad and on good texts: ``rates[labeller, class, vote]``."""

    prior: float
    rates: np.ndarray

    def posterior(self, pattern: str) -> float:
        """Probability of a good text. A labeller that looks for one defect tells
        something by abstaining too, so all three votes count by their rates."""
        log = np.log([1 - self.prior, self.prior])
        for rate, vote in zip(self.rates, pattern):
            if vote != ".":
                log = log + np.log(rate[:, "01-".index(vote)])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))

    def accuracies(self) -> list[float]:
        """Share of right votes of each labeller among those it gives."""
        weights = np.array([1 - self.prior, self.prior])
        given = (self.rates[:, :, :2] * weights[None, :, None]).sum(axis=(1, 2))
        right = (self.rates[:, [0, 1], [0, 1]] * weights).sum(axis=1)
        return (right / np.maximum(given, 1e-12)).tolist()


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over the counts of vote patterns.

    Starts from labellers that agree with the class with AGREEMENT and from the PRIOR
    of good texts, which tells the two classes apart; SMOOTHING votes of that start
    stay in each rate, so labellers that never vote keep it. A vote is taken to be at
    least BETTER times as likely on its own class as on the other, or correlated
    labellers could turn one that disagrees with them upside down.
    """
    m = len(LABELLERS)
    start = np.full((m, 2, 3), (1 - AGREEMENT) / 2)
    start[:, [0, 1], [0, 1]] = AGREEMENT
    model = LabelModel(PRIOR, start)
    if not counts:
        return model
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.zeros((len(patterns), m, 3))
    for i, pattern in enumerate(patterns):
        for j, vote in enumerate(pattern):
            if vote != ".":
                seen[i, j, "01-".index(vote)] = 1
    for _ in range(rounds):
        good = np.array([model.posterior(p) for p in patterns])
        share = np.stack((1 - good, good)) * n
        rates = np.einsum("cp,pjv->jcv", share, seen) + SMOOTHING * start
        rates /= rates.sum(axis=2, keepdims=True)
        for vote in (0, 1):
            most = rates[:, vote, vote] / BETTER
            rates[:, 1 - vote, vote] = np.minimum(rates[:, 1 - vote, vote], most)
        prior = float(np.clip(share[1].sum() / n.sum(), 0.01, 0.99))
        new = LabelModel(prior, rates / rates.sum(axis=2, keepdims=True))
        done = abs(new.prior - model.prior) < 1e-9
        model = new
        if done:
            break
    return model


# --- the scorer ---------------------------------------------------------------------

_RUNS = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "9"))


@lru_cache(HELD)
def shape(word: bytes) -> int:
    """Bucket of a word's outline: runs of letters, capitals and digits become one sign."""
    text = word[:200].decode(errors="replace")
    for pattern, sign in _RUNS:
        text = pattern.sub(sign, text)
    return zlib.crc32(text[:12].encode()) % BUCKETS


def vector(text: bytes) -> tuple[list[int], list[float]]:
    """Hashed features of a whole text: square roots of the shares of word outlines,
    and the level of each statistic."""
    words = words_of(text)
    if not words:
        return [zlib.crc32(b"empty") % BUCKETS], [1.0]
    found = np.bincount(np.fromiter(map(shape, words), np.int64, len(words)), minlength=BUCKETS)
    at = np.flatnonzero(found)
    values = np.sqrt(found[at] / len(words))
    levels = []
    for name, x in zip(STATISTICS, statistics(text)):
        level = int(np.log2(x)) if x >= 1 else round(min(x, 1.0) * 20)
        levels.append(zlib.crc32(f"{name}:{level}".encode()) % BUCKETS)
    return [*at.tolist(), *levels], [*values.tolist(), *[1.0] * len(levels)]


def _sample_vectors(model: LabelModel):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                target = model.posterior(_pattern(votes(statistics(text))))
                rows.append((target, *vector(text)))
            if rows:
                kinds = [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
                yield batch_of([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["target", "at", "value"])

    return run


def fit_scorer(rows: list[tuple[float, list[int], list[float]]]) -> np.ndarray:
    """Weights by bucket and the bias, for targets between 0 and 1, by Adam."""
    target = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([a for r in rows for a in r[1]], np.int64)
    value = np.array([v for r in rows for v in r[2]])
    w, first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, STEPS + 1):
        score = w[-1] + np.bincount(row, w[at] * value, len(rows))
        gap = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - target) / len(rows)
        slope = np.append(np.bincount(at, gap[row] * value, BUCKETS) + SHRINK / len(rows) * w[:-1], gap.sum())
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        at, value = vector(text)
        total = self.weights[-1] + float(self.weights[at] @ np.array(value))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Counts the votes of all texts, estimates the labellers and fits the scorer to
    the posteriors of at most ``sample_rows`` texts. No given label is read."""
    plain = texts(docs)
    counted = mapped(plain.select("text"), _count_patterns, "pattern string, n long").groupBy("pattern")
    # at most three votes for each of a fixed number of labellers
    counts = {r["pattern"]: r["n"] for r in counted.agg(F.sum("n").alias("n")).collect()}
    labels = estimate(counts)
    order = F.xxhash64("doc_id")
    chosen = plain.select("doc_id").distinct().orderBy(order, "doc_id").limit(sample_rows)
    # at most sample_rows ids
    sample = plain.join(F.broadcast(chosen), plain["doc_id"].eqNullSafe(chosen["doc_id"])).select("text")
    found = mapped(sample, _sample_vectors(labels), "target double, at array<int>, value array<float>")
    rows = [tuple(r) for r in found.limit(sample_rows).collect()]
    return Model(labels, fit_scorer(rows) if rows else np.zeros(BUCKETS + 1))


def score_quality(docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text, from 0 to 1.

    Only ``text`` is read; a null text scores like an empty one. Rows may repeat, an
    empty table gives none; ``name`` gets underscores where it is taken.
    """
    name = fresh(docs, name)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            content = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).fill_null(b"")
            scores = [model.score(t) for t in content.to_pylist()]
            yield batch_of([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return mapped(docs, run, T.StructType([*docs.schema.fields]).add(name, T.DoubleType()))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least 0.5, as they are."""
    name = fresh(docs, "quality")
    return score_quality(docs, fit(docs), name).filter(F.col(name) >= KEEP).drop(name)
