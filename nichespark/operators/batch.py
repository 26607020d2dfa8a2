"""Batch correction: what stands in for a conditional autoencoder."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TRVAE:
    """A conditional variational autoencoder needs torch, which this engine has not; bring its latent columns instead."""

    def __init__(self, *args, **kwargs):
        raise ImportError("TRVAE needs torch; store its latent vectors in a column and pass it as use_rep, or see standardised_pca")


def standardised_pca(cells: DataFrame, condition_key: str, use_rep: str = "features", latent_dim: int = 10, out_key: str = "X_pca") -> DataFrame:
    """cells with out_key: features standardised within each condition, then principal components. Not the same as TRVAE."""
    dims = cells.agg(F.max(F.size(use_rep))).first()[0]
    f = [F.col(use_rep)[i] for i in range(dims)]
    stats = cells.groupBy(condition_key).agg(F.array(*[F.avg(x) for x in f]).alias("mean_of"), F.array(*[F.stddev_pop(x) for x in f]).alias("sd_of"))
    scaled = cells.join(stats, condition_key).withColumn("scaled", F.transform(use_rep, lambda x, i: F.coalesce(F.try_divide(x - F.col("mean_of")[i], F.col("sd_of")[i]), F.lit(0.0))))
    scaled = scaled.withColumn("vector", array_to_vector("scaled"))
    return PCA(k=min(latent_dim, dims), inputCol="vector", outputCol="pc").fit(scaled).transform(scaled).withColumn(out_key, vector_to_array("pc")).select(*cells.columns, out_key)
