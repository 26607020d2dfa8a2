"""Connected components of cells, by cluster if asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.functions.ranking import global_rank
from nichespark.operators.prune import with_labels
from nichespark.operators.star import star_components


def connected_components(cells: DataFrame, edges: DataFrame, cluster_key: str | None = None, min_cells: int = 250, out_key: str = "component") -> DataFrame:
    """cell_id and out_key for every cell; null in components of fewer than min_cells and without a cluster.

    Components are numbered from "0": clusters in the order of their first cell, within them
    components in the order of theirs.
    """
    need(cells, "cell_id", cluster_key)
    own = cells.select("cell_id", (F.col(cluster_key).cast("string") if cluster_key else F.lit("")).alias("cluster")).where("cluster is not null")
    pairs = edges.select("src", "dst")
    if cluster_key:
        pairs = with_labels(pairs, cells, cluster_key).where("ls = ld").select("src", "dst")
    loops = own.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))
    found = star_components(pairs.unionByName(loops)).withColumnRenamed("component", "root").join(own, F.col("node") == F.col("cell_id"))
    sizes = found.groupBy("root", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    first = own.groupBy("cluster").agg(F.min("cell_id").alias("first"))
    ranked = global_rank(sizes.join(first, "cluster").select("root", "first"), ["first", "root"])
    named = found.join(ranked.select("root", F.col("rank").cast("string").alias(out_key)), "root")
    return cells.select("cell_id").join(named.select("cell_id", out_key), "cell_id", "left")
