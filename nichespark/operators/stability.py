"""Similarity of clusterings from contingency tables, and stability over numbers of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(labels: DataFrame) -> DataFrame:
    """k, run_a, run_b, l1, l2, n: each run's labels at k against those at k + 1 of every earlier run.

    labels: run, k, cell_id, label. Only numbers of clusters with a direct successor count.
    """
    a = labels.select("cell_id", "k", F.col("run").alias("run_a"), F.col("label").alias("l1"))
    b = labels.select("cell_id", (F.col("k") - 1).alias("k"), F.col("run").alias("run_b"), F.col("label").alias("l2"))
    return a.join(b, ["cell_id", "k"]).where("run_b < run_a").groupBy("k", "run_a", "run_b", "l1", "l2").agg(F.count("*").alias("n"))


def same_k_pairs(labels: DataFrame) -> DataFrame:
    """k, run_a, run_b, l1, l2, n for every two runs at the same k, run_b < run_a."""
    a = labels.select("cell_id", "k", F.col("run").alias("run_a"), F.col("label").alias("l1"))
    b = labels.select("cell_id", "k", F.col("run").alias("run_b"), F.col("label").alias("l2"))
    return a.join(b, ["cell_id", "k"]).where("run_b < run_a").groupBy("k", "run_a", "run_b", "l1", "l2").agg(F.count("*").alias("n"))


def _sums(table: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    cells = table.groupBy(*keys).agg(F.sum(n * n).alias("nij2"), F.sum(n).alias("nn"))
    rows = table.groupBy(*keys, "l1").agg(F.sum(n).alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("a2"))
    cols = table.groupBy(*keys, "l2").agg(F.sum(n).alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("b2"))
    return cells.join(rows, keys).join(cols, keys)


def fowlkes_mallows(table: DataFrame, keys: tuple[str, ...] = ("k", "run_a", "run_b")) -> DataFrame:
    """keys, value: TK / sqrt(PK * QK); 0 where no pair is together."""
    s = _sums(table, list(keys))
    tk, pk, qk = F.col("nij2") - F.col("nn"), F.col("a2") - F.col("nn"), F.col("b2") - F.col("nn")
    return s.select(*keys, F.when(tk != 0, F.sqrt(tk / F.nullif(pk, F.lit(0.0))) * F.sqrt(tk / F.nullif(qk, F.lit(0.0)))).otherwise(0.0).alias("value"))


def adjusted_rand(table: DataFrame, keys: tuple[str, ...] = ("k", "run_a", "run_b")) -> DataFrame:
    """keys, value: (index - expected) / (maximum - expected) over pairs; 1 where all agree by necessity."""
    s = _sums(table, list(keys))
    index, a, b, total = (F.col("nij2") - F.col("nn")) / 2, (F.col("a2") - F.col("nn")) / 2, (F.col("b2") - F.col("nn")) / 2, F.col("nn") * (F.col("nn") - 1) / 2
    expected = F.try_divide(a * b, total)
    return s.select(*keys, F.coalesce(F.try_divide(index - expected, (a + b) / 2 - expected), F.lit(1.0)).alias("value"))


def mirror(scores: DataFrame) -> DataFrame:
    """k, part, run_a, run_b, value: for interior k the scores of (k, k + 1) and of (k - 1, k)."""
    ends = scores.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    up = scores.withColumn("part", F.lit(0))
    down = scores.withColumn("k", F.col("k") + 1).withColumn("part", F.lit(1))
    both = up.unionByName(down).crossJoin(F.broadcast(ends)).where("k > lo and k <= hi")
    return both.select("k", "part", "run_a", "run_b", "value")


def mean_stability(mirrored: DataFrame) -> DataFrame:
    return mirrored.groupBy("k").agg(F.avg("value").alias("stability"), F.stddev_samp("value").alias("spread"), F.count("*").alias("n"))


def best_k(means: DataFrame) -> DataFrame:
    """One row: the k of the largest mean stability, the smallest on ties."""
    return means.orderBy(F.desc("stability"), "k").limit(1).select("k", "stability")


def peaks(means: DataFrame) -> DataFrame:
    """k, stability of local maxima; of a flat top the middle (rounded down); ends are no peaks.

    There is a row for each number of clusters, so one ordered window over all is small.
    """
    by = Window.orderBy("k")
    step = F.coalesce(F.col("stability") != F.lag("stability").over(by), F.lit(True)).cast("int")
    flat = means.withColumns({"i": F.row_number().over(by), "flat": F.sum(step).over(by)})
    tops = flat.groupBy("flat").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("stability").alias("stability"))
    w = Window.orderBy("flat")
    tops = tops.withColumns({"before": F.lag("stability").over(w), "after": F.lead("stability").over(w)}).where("stability > before and stability > after")
    return tops.withColumn("i", F.expr("(a + b) div 2").cast("int")).select("i").join(flat, "i").select("k", "stability")


def mape(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row: mean absolute percentage error of now's stability against before's, by k."""
    a, b = before.select("k", F.col("stability").alias("a")), now.select("k", F.col("stability").alias("b"))
    return a.join(b, "k").agg(F.avg(F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.lit(2.220446049250313e-16))).alias("mape"))
