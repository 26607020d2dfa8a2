"""Proportions and enrichment of groups by labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.functions.aggregates import log_ratio
from nichespark.functions.checks import need, with_params
from nichespark.operators.deal import deal, dealt_sums


def proportion(cells: DataFrame, id_key: str, val_key: str, normalize: bool = True) -> DataFrame:
    """id, val, value for every pair of values that occur: counts, or their share within id."""
    need(cells, id_key, val_key)
    both = cells.select(F.col(id_key).cast("string").alias("id"), F.col(val_key).cast("string").alias("val")).where("id is not null and val is not null")
    counted = both.groupBy("id", "val").agg(F.count("*").alias("n"))
    # the domains are label sets: small by nature, each made of the counts
    pairs = counted.select("id").distinct().crossJoin(counted.select("val").distinct()).join(counted, ["id", "val"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("id")))
    return pairs.select("id", "val", (share if normalize else F.col("n").cast("double")).alias("value"))


def enrichment(cells: DataFrame, group_key: str, label_key: str, pvalues: bool = False, n_perms: int = 1000, log: bool = True, seed: int = 0) -> DataFrame:
    """group, label, observed, expected, enrichment (and pvalue) for every pair of values that occur.

    observed: share of the group among the label's cells. expected: share of the group among all
    cells, those without a group included; with pvalues the mean over permutations. pvalue: 1 -
    share of permutations below what is observed, 0 where nothing is observed. Permutations deal the groups anew (see deal).
    """
    need(cells, group_key, label_key)
    base = cells.select(F.col(group_key).cast("string").alias("g"), F.col(label_key).cast("string").alias("l"))
    counted = base.groupBy("g", "l").agg(F.count("*").alias("n"))
    seen = counted.where("g is not null and l is not null")
    per_group = counted.where("g is not null").groupBy("g").agg(F.sum("n").alias("ng"))
    total = counted.agg(F.sum("n").alias("nn"))
    pairs = per_group.crossJoin(F.broadcast(total)).crossJoin(seen.select("l").distinct()).join(seen, ["g", "l"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = pairs.select("g", "l", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("l"))).alias("o"), (F.col("ng").cast("double") / F.col("nn")).alias("e"))
    if pvalues:
        labelled = cells.select("cell_id", F.col(label_key).cast("string").alias("l")).where("l is not null")
        c = dealt_sums(labelled, deal(cells, group_key, n_perms, seed), ["cell_id"], fixed="l").where("l0 is not null")
        perms = c.select("perm", F.col("l0").alias("g"), "l", (F.col("w") / F.sum("w").over(Window.partitionBy("perm", "l"))).alias("o"))
        joined = rows.join(perms.select("g", "l", "perm", F.col("o").alias("po")), ["g", "l"], "left")
        per = joined.groupBy("g", "l", "o").agg(F.sum(F.coalesce("po", F.lit(0.0))).alias("s"), F.sum(F.when(F.col("po") < F.col("o"), 1).otherwise(0)).alias("below"), F.count("po").alias("k"))
        # a pair that a permutation hasn't made has the share 0 there
        below = F.col("below") + F.when(F.col("o") > 0, n_perms - F.col("k")).otherwise(0)
        rows = per.select("g", "l", "o", (F.col("s") / n_perms).alias("e"), F.when(F.col("o") > 0, 1 - below.cast("double") / n_perms).otherwise(0.0).alias("p"))
    change = log_ratio(F.col("o"), F.col("e"), log)
    filled = F.coalesce(change, F.min(change).over(Window.partitionBy("l")))
    out = rows.select(F.col("g").alias("group"), F.col("l").alias("label"), F.col("o").alias("observed"), F.col("e").alias("expected"), filled.alias("enrichment"), *([F.col("p").alias("pvalue")] if pvalues else []))
    return with_params(out, group_key=group_key, label_key=label_key, pvalues=pvalues, n_perms=n_perms if pvalues else None, seed=seed if pvalues else None, log=log)
