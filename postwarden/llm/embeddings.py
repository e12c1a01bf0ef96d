"""Near copies among embeddings by E8 lattice hashing.

A table projects each unit vector at random to eight dimensions for each of its
lattices and decodes the projections to the nearest points of E8: the points are the
vector's cell. It also probes the cells of the next lattice points around. A cell
compares its own vectors with each other and with those that probe it, in blocks of a
bounded number of rows, by exact cosines; a pair that meets in several cells counts
in the first only. Blocks return how many vectors each one links to and a spanning
forest, never pairs. Equal vectors are one vector with a count.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import Batches, batch_of, mapped
from .components import components

COSINE = 0.95
#: Lattices of a table -> tables, scale of the projection and neighbours probed by
#: each lattice. A pair at the threshold meets with probability 0.998, 0.999 and
#: 0.999; unrelated vectors meet in a table with about 5e-3, 5e-4 and 3e-5.
PLANS = {1: (8, 1.8, 1), 2: (12, 2.2, 1), 3: (28, 2.4, 1)}
#: Lattices of a table at any size of the input, so that the same vectors link in the same
#: way whatever is beside them. Up to ``ONE_UP_TO`` distinct vectors cells stay small; beyond,
#: their comparisons grow with the square, in blocks of the same bounded size.
LATTICES = 1
ONE_UP_TO = 1_000_000
#: Rows of a slice of a cell; a block holds two slices.
SLICE_ROWS = 2048
SEED = 20


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            found.append(v)
    found += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the coordinate
    that was rounded furthest goes the other way."""
    near = np.rint(x)
    gap = x - near
    line, worst = np.arange(len(x)), np.abs(gap).argmax(axis=1)
    odd = near.sum(axis=1) % 2 != 0
    near[line, worst] += np.where(odd, np.where(gap[line, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is the even points and those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _packed(points: np.ndarray) -> np.ndarray:
    """Doubled coordinates as bytes of one number; projections of unit vectors stay
    far below the 63 that fit."""
    doubled = np.clip(np.rint(2 * points), -127, 127).astype(np.int8)
    return np.ascontiguousarray(doubled).view(np.uint64)[..., 0]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(parts[0])
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


@lru_cache(maxsize=8)
def _projections(dimension: int, tables: int, lattices: int, scale: float) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).normal(size=(tables, lattices, dimension, 8)) / scale


def cells(vectors: np.ndarray, lattices: int = 1) -> np.ndarray:
    """Own cell and then probed cells of unit vectors, as (rows, tables, cells)."""
    tables, scale, probes = PLANS[lattices]
    around, out = minimal_vectors(), []
    for matrices in _projections(vectors.shape[1], tables, lattices, scale):
        choices = []
        for matrix in matrices:
            at = vectors @ matrix
            own = decode(at)
            # the neighbour nearest to x is the minimal vector with the largest product with x - own
            reach = (at - own) @ around.T
            nearest = np.argpartition(-reach, probes - 1, axis=1)[:, :probes]
            points = np.concatenate((own[:, None, :], own[:, None, :] + around[nearest]), axis=1)
            choices.append(_packed(points))
        out.append(np.stack([_mixed([c[:, i] for c, i in zip(choices, pick)]) for pick in product(*[range(probes + 1)] * lattices)], axis=1))
    return np.stack(out, axis=1).view(np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _emit(lattices: int, with_vectors: bool):
    """Rows of a dimension, table and cell for each distinct vector."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for dimension in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == dimension))
                for at in range(0, some.num_rows, 1024):
                    part = some.slice(at, 1024)
                    vectors = _matrix(part.column("embedding"), dimension)
                    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    found = cells(unit, lattices)
                    rows, tables, each = found.shape
                    index = np.repeat(np.arange(rows), tables * each)
                    columns = {
                        "dimension": pa.array(np.full(len(index), dimension, np.int32)),
                        "table": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), rows)),
                        "cell": pa.array(found.ravel()),
                        "own": pa.array(np.tile(np.arange(each) == 0, rows * tables)),
                    }
                    if with_vectors:
                        raw = pa.array([v.tobytes() for v in unit], pa.binary())
                        keys = pa.array([k.tobytes() for k in found], pa.binary())
                        take = pa.array(index)
                        columns |= {
                            "rep": part.column("rep").take(take),
                            "n": part.column("n").take(take),
                            "unit": raw.take(take),
                            "keys": keys.take(take),
                        }
                    yield batch_of(list(columns.values()), list(columns))

    return run


def _earlier(table: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` met in a table before."""
    met = np.zeros(len(a), bool)
    for s in range(table):
        met |= (keys[b, s] == keys[a, s, :1]).any(axis=1) | (keys[a, s] == keys[b, s, :1]).any(axis=1)
    return met


def block_links(
    table: int, rep: np.ndarray, n: np.ndarray, unit: np.ndarray, keys: np.ndarray, own: np.ndarray, side: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row of a block links to, and the label of its component
    there. ``side`` tells two slices apart, whose inner pairs have blocks of their own;
    with one side all pairs count. Only pairs that no other block counts are added."""
    links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    mixed = side.min() != side.max()
    pairs = []
    for at in range(0, len(rep), 256):
        close = unit[at : at + 256] @ unit.T >= cosine
        a, b = np.nonzero(close)
        a += at
        keep = (a < b) & (own[a] | own[b])
        if mixed:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        # a pair with one owner here may also meet in the other's cell: the lower rep's cell counts
        owner, guest = np.where(own[a], a, b), np.where(own[a], b, a)
        both = own[a] & own[b]
        returned = (keys[owner, table] == keys[guest, table, :1]).any(axis=1)
        first = both | ~returned | (rep[owner] < rep[guest])
        a, b = a[first], b[first]
        fresh = ~_earlier(table, keys, a, b)
        a, b = a[fresh], b[fresh]
        links += np.bincount(a, n[b], len(rep)).astype(np.int64) + np.bincount(b, n[a], len(rep)).astype(np.int64)
        pairs.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return links, label


_FOUND = "rep long, links long, other long"


def _compare(lattices: int, cosine: float):
    tables, _, probes = PLANS[lattices]
    each = (probes + 1) ** lattices

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        take = lambda name: rows.column(name).to_numpy()
        rep = take("rep")
        unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(len(rep), tables, each)
        links, label = block_links(key[1].as_py(), rep, take("n"), unit, keys, take("own"), take("side"), cosine)
        hit = links > 0
        return pa.table({"rep": rep[hit], "links": links[hit], "other": rep[label[hit]]})

    return block


def usable(column: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def linked_vectors(distinct: DataFrame, lattices: int, cosine: float = COSINE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rep``, ``links`` and ``other``: parts of the number of vectors that a distinct
    vector (``rep``, ``embedding``, ``n``) links to, and one that it is connected to."""
    place = ["dimension", "table", "cell"]
    kind = "dimension int, table int, cell long, own boolean"
    used = mapped(distinct, _emit(lattices, False), kind).groupBy(*place)
    used = used.agg(F.count(F.lit(1)).alias("n_rows"), F.max("own").alias("owned")).filter("owned and n_rows > 1")
    used = cut_lineage(used.select(*place, F.ceil(F.col("n_rows") / slice_rows).cast("int").alias("slices")))
    rows = mapped(distinct, _emit(lattices, True), f"{kind}, rep long, n long, unit binary, keys binary")
    rows = rows.join(used, place).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("slices", "other")
    return rows.groupBy(*place, "low", "high").applyInArrow(_compare(lattices, cosine), _FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link
    with nothing, nor do rows with a null id; they are components of their own and
    kept. Vectors of different length never link. Rows that repeat a vector or an id
    are vectors of their own and link with each other. An empty table gives no rows;
    columns beside vec_id and embedding are not looked at.
    """
    plain = vectors.select("vec_id", "embedding")
    good = plain.filter(usable("embedding") & F.col("vec_id").isNotNull())
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # vectors that differ may share their smallest id if ids repeat
    distinct = cut_lineage(distinct.withColumn("same", F.struct("rep", F.xxhash64("embedding"))))
    distinct = distinct.withColumn("rep", F.xxhash64("same")).withColumn("lowest", F.col("same.rep"))
    found = cut_lineage(linked_vectors(distinct.select("rep", "embedding", "n"), LATTICES, cosine, slice_rows))
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    named = cut_lineage(named.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
    roots = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = named.join(roots, "component").select("embedding", "links", "component_id")
    # the embedding of a row that may link, so that other rows stay unmatched
    asked = F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.col("embedding"))
    rows = plain.select("vec_id", asked.alias("embedding")).join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
