"""Cell tables: loading, and stand-in views of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical schema of a cell table.
CELLS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("sample", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_cells(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A cell table from Parquet, ORC, CSV or JSON."""
    reader = spark.read.options(**options)
    return reader.load(path, format=kind) if kind in ("parquet", "orc") else reader.schema(CELLS).load(path, format=kind)


def cells_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a lattice 40 wide: market segment as cluster, nation as sample, its parity as condition."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cluster"),
        F.col("c_nationkey").cast("string").alias("sample"),
        (F.col("c_nationkey") % 2).cast("string").alias("condition"),
        F.col("c_acctbal").alias("value"),
        (F.col("c_custkey") % 40).alias("gx"),
        F.expr("c_custkey div 40").alias("gy"),
    )


def cells_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a lattice 400 wide: priority as cluster, status as condition (three)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("o_orderpriority").alias("cluster"),
        F.col("o_orderstatus").alias("condition"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_orderkey") % 400).alias("gx"),
        F.expr("o_orderkey div 400").alias("gy"),
    )


def cells_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: type as cluster, last digit of the user as group."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("event_type").alias("cluster"), (F.col("user_id") % 10).cast("string").alias("grp"), F.col("value"), F.col("ts"))


def cells_emb(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """Embeddings: the first two dimensions as place, the first `dims` as features, label as cluster."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select(
        F.col("vec_id").alias("cell_id"),
        F.col("label").cast("string").alias("cluster"),
        (F.col("vec_id") % 4).cast("string").alias("sample"),
        F.col("v")[0].alias("x"),
        F.col("v")[1].alias("y"),
        F.slice("v", 1, dims).alias("features"),
    )


def runs(spark: SparkSession, sf_dir: str, n_runs: int = 4, ks: tuple[int, int] = (2, 6), agreed: tuple[int, int] = (0, 0)) -> DataFrame:
    """Made-up clusterings: run, k, cell_id, label; at the numbers of clusters from agreed[0] to agreed[1] all runs are alike."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("l"))
    grid = e.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1)))).withColumn("k", F.explode(F.sequence(F.lit(ks[0]), F.lit(ks[1]))))
    alike = F.when(F.col("k").between(*agreed), F.col("l") % 2)
    return grid.select("run", "k", "cell_id", F.coalesce(alike, (F.expr("cell_id div 16") * (2 * F.col("run") + 1) + F.col("l")) % F.col("k")).cast("int").alias("label"))
