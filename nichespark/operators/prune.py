"""Removing edges: links that are too long, and links within a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.functions.ranking import exact_percentile


def long_link_threshold(edges: DataFrame, distance_percentile: float = 99.0, dist: str = "dist") -> float | None:
    """The interpolated percentile of all positive distances, every direction counted."""
    need(edges, dist)
    return exact_percentile(edges.where(F.col(dist) > 0), dist, distance_percentile / 100.0)


def remove_long_links(edges: DataFrame, distance_percentile: float = 99.0, dist: str = "dist", sample_edges: DataFrame | None = None) -> DataFrame:
    """Edges no longer than the threshold, with the threshold as column `radius`; null and zero distances stay."""
    limit = long_link_threshold(edges if sample_edges is None else sample_edges, distance_percentile, dist)
    kept = edges if limit is None else edges.where(F.col(dist).isNull() | (F.col(dist) <= limit))
    return kept.withColumn("radius", F.lit(limit).cast("double"))


def with_labels(edges: DataFrame, cells: DataFrame, key: str, src: str = "ls", dst: str = "ld") -> DataFrame:
    """edges with the labels of both ends (null where there is none)."""
    need(cells, "cell_id", key)
    label = cells.select("cell_id", F.col(key).cast("string").alias("l"))
    a = label.select(F.col("cell_id").alias("src"), F.col("l").alias(src))
    b = label.select(F.col("cell_id").alias("dst"), F.col("l").alias(dst))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def remove_intra_cluster_links(edges: DataFrame, cells: DataFrame, cluster_key: str) -> DataFrame:
    """Edges whose ends have different labels; a null label differs from every label."""
    marked = with_labels(edges, cells, cluster_key)
    return marked.where(~F.coalesce(F.col("ls") == F.col("ld"), F.lit(False))).select(*edges.columns)
