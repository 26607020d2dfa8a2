"""Bundled datasets. There is no download: a loader reads a table that is already there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from nichespark.sources.tables import load_cells


@dataclass(frozen=True)
class DatasetMetadata:
    """What a dataset is and how large."""

    name: str
    n_cells: int
    n_features: int


MOUSE_SPLEEN = DatasetMetadata("codex_mouse_spleen", 707_474, 29)


def codex_mouse_spleen(spark: SparkSession, path: str) -> DataFrame:
    """The mouse spleen cells, exported to Parquet at path; FileNotFoundError if there is nothing."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return load_cells(spark, path)
