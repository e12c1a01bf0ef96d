"""Connected components of a graph of links, by alternating stars.

Each half round points the neighbours of a node at the smallest node it sees. A
node's smallest neighbour is an aggregate that combines before the shuffle, and
the join that follows has one row per node on one side, so a centre with a large
share of all links is split like any skewed join. The links never outgrow their
first number, and each half round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.join(_smallest(both), "a").filter(F.col("b") > F.col("a"))
    return seen.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Takes links with a > b, as the large star leaves them."""
    lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(lowest, "a").filter(F.col("b") > F.col("m"))
    moved = others.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lowest.select("a", F.col("m").alias("b")).union(moved).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of a
    table of links ``a``, ``b`` (longs, any direction, repeats and loops allowed).

    Nodes without a link to another node are absent; an empty table gives none.
    """
    links = cut_lineage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(links)
    while before[0]:
        links = cut_lineage(_small_star(_large_star(links)))
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
