"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.runtime import LEAST, join_counted, settle


def _settle(df: DataFrame, n_rows: int) -> DataFrame:
    """Settled in partitions of half a million rows or so: a round has few tasks where it has few pairs."""
    return settle(df.coalesce(max(8, n_rows // 500_000)))


def _known(least: DataFrame, n_pairs: int) -> DataFrame:
    """The minima, settled where their hubs are to be looked up."""
    return _settle(least, n_pairs) if n_pairs > LEAST else least


def _with_least(pairs: DataFrame, least: DataFrame, n_pairs: int) -> DataFrame:
    """pairs with m, their node's minimum; a node with very many pairs is joined by broadcast."""
    return join_counted(pairs, least, "u", n_pairs) if n_pairs > LEAST else pairs.join(least.drop("n"), "u")


def _large_star(pairs: DataFrame, n_pairs: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _known(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), 2 * n_pairs)
    return _with_least(both.where("v > u"), least, 2 * n_pairs).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame, n_pairs: int) -> DataFrame:
    # every pair has u > v here
    least = _known(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n_pairs)
    moved = _with_least(pairs, least, n_pairs).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component for every node of an undirected edge list; component is its smallest node id.

    Both stars aggregate a minimum per node (partial aggregation first) and join it back, so that
    no node's neighbours are gathered in one row, and nodes with very many pairs are joined by
    broadcast (see join_counted). The number of rounds grows with the logarithm of
    the longest path. Self-loops give a component of one node; rows with a null end are ignored.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    pairs = settle(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = ends.where("a = b").select(F.col("a").alias("u"))

    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = sign(pairs)
    for _ in range(max_rounds):
        # each row of the one star is a row of the pairs, so their number bounds both
        large = _large_star(pairs, before[0])
        pairs = _settle(_small_star(_settle(large, before[0]) if before[0] > LEAST else large, before[0]), before[0])
        now = sign(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("v"))
    own = pairs.select(F.col("v").alias("u")).unionByName(loops).distinct().join(roots.select("u"), "u", "left_anti")
    return roots.unionByName(own.select("u", F.col("u").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("component"))
