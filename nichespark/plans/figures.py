"""The tables that figures are drawn from. Nothing is drawn here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.operators import group, nhood, stability


def proportion(cells: DataFrame, group_key: str, label_key: str, groups: list[str] | None = None, labels: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """id, val, value, position: bars of label shares per group, restricted after normalising, labels in reverse order."""
    rows = group.proportion(cells, group_key, label_key, normalize)
    rows = rows.where(F.col("id").isin(groups)) if groups else rows
    rows = rows.where(F.col("val").isin(labels)) if labels else rows
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("val"))))


def leaf_order(names: list[str], matrix: np.ndarray) -> list[str]:
    """Names in the leaf order of complete-linkage clustering of the rows (a small matrix)."""
    clusters = [([i], i) for i in range(len(names))]
    d = np.sqrt(((matrix[:, None, :] - matrix[None]) ** 2).sum(2))
    while len(clusters) > 1:
        pairs = [(max(d[i, j] for i in a[0] for j in b[0]), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y]
        _, x, y = min(pairs)
        merged = (clusters[x][0] + clusters[y][0], 0)
        clusters = [c for i, c in enumerate(clusters) if i not in (x, y)] + [merged]
    return [names[i] for i in clusters[0][0]] if clusters else []


def finite(rows: DataFrame, column: str) -> DataFrame:
    """Infinities replaced by the largest and smallest finite value, nulls and NaN by 0."""
    v = F.col(column)
    usual = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    ends = rows.agg(F.min(usual).alias("lo"), F.max(usual).alias("hi"))
    fixed = F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), F.col("hi")).when(v == float("-inf"), F.col("lo")).otherwise(v)
    return rows.crossJoin(F.broadcast(ends)).withColumn(column, fixed).drop("lo", "hi")


def enrichment(result: DataFrame, dot_scale: float = 3, groups: list[str] | None = None, labels: list[str] | None = None, show_pvalues: bool = False, significance: float | None = None, enriched_only: bool = True, significant_only: bool = False, size_threshold: float | None = None, group_cluster: bool = True, label_cluster: bool = False) -> DataFrame:
    """group, label, value, size, color, group_order, label_order: the dots of an enrichment figure. result: of operators.group.enrichment.

    color: with significance 0 or 0.8, with show_pvalues the p-value, else 0. Orders are the leaf orders
    of complete-linkage clusterings (null where not asked for).
    """
    if (show_pvalues or significance is not None or significant_only) and "pvalue" not in result.columns:
        raise ValueError("the enrichment was computed without p-values")
    for name, wanted in (("group", groups), ("label", labels)):
        if wanted:
            known = {r[0] for r in result.select(name).distinct().collect()}
            if missing := set(wanted) - known:
                raise ValueError(f"unknown {name}s: {sorted(missing)}")
            result = result.where(F.col(name).isin(wanted))
    rows = finite(result, "enrichment").withColumnRenamed("enrichment", "value")
    orders = {}
    for name, other, asked in (("group", "label", group_cluster), ("label", "group", label_cluster)):
        if asked:
            wide = rows.groupBy(name).pivot(other).agg(F.first("value")).orderBy(name).toPandas()
            orders[name] = leaf_order(list(wide[name]), wide.drop(columns=name).to_numpy(float)) if len(wide) > 1 else list(wide[name])
    limit = F.least(F.abs("value"), F.lit(float(size_threshold))) if size_threshold is not None else F.abs("value")
    rows = rows.withColumn("size", limit).withColumn("size", F.coalesce(F.try_divide(F.col("size") * 100.0, F.max("size").over(Window.partitionBy())) * float(dot_scale), F.lit(0.0)))
    if significance is not None:
        color = F.when(F.col("pvalue") <= significance, 0.0).otherwise(0.8)
    elif show_pvalues:
        color = F.col("pvalue") + 0.0001
    else:
        color = F.lit(0.0)
    rows = rows.withColumn("color", color)
    if enriched_only:
        rows = rows.where("value >= 0")
    if significant_only:
        rows = rows.where(F.col("pvalue") <= (0.05 if significance is None else significance))
    place = {x: F.array_position(F.array(*[F.lit(v) for v in orders[x]]), F.col(x)) if orders.get(x) else F.lit(None).cast("long") for x in ("group", "label")}
    return rows.select("group", "label", "value", "size", "color", place["group"].alias("group_order"), place["label"].alias("label_order"))


def nhood_enrichment(result: DataFrame, cells: DataFrame | None = None, cluster_key: str | None = None, row_groups: list[str] | None = None, col_groups: list[str] | None = None, min_freq: float | None = None, transpose: bool = False, significance: float | None = None, n_digits: int = 2) -> DataFrame:
    """row, col, value, star: a heat map of neighbourhood enrichment; infinite values and rare clusters are null."""
    v = F.col("enrichment")
    rows = result.withColumn("value", F.when(F.abs(v) != float("inf"), v))
    if min_freq is not None:
        need(cells, cluster_key)
        labelled = cells.select(F.col(cluster_key).cast("string").alias("c")).where("c is not null")
        share = labelled.groupBy("c").agg(F.count("*").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col("f") >= min_freq)
        a, b = share.select(F.col("c").alias("source"), F.lit(True).alias("oa")), share.select(F.col("c").alias("target"), F.lit(True).alias("ob"))
        rows = rows.join(a, "source", "left").join(b, "target", "left").withColumn("value", F.when(F.col("oa") & F.col("ob"), F.col("value")))
    a, b = ("target", "source") if transpose else ("source", "target")
    rows = rows.withColumns({"row": F.col(a), "col": F.col(b)})
    rows = rows.where(F.col("row").isin(row_groups)) if row_groups else rows
    rows = rows.where(F.col("col").isin(col_groups)) if col_groups else rows
    star = F.when(F.col("pvalue") <= significance, "*").otherwise("") if significance is not None else F.lit("")
    return rows.select("row", "col", F.round("value", n_digits).alias("value"), star.alias("star"))


def diff_nhood_enrichment(result: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """condition1, condition2, source, target, value for each wanted pair; of a pair stored the other way round the negative."""
    spark = result.sparkSession
    p = F.broadcast(spark.createDataFrame(pairs, "w1 string, w2 string"))
    same = result.join(p, (F.col("condition1") == F.col("w1")) & (F.col("condition2") == F.col("w2"))).select("w1", "w2", "source", "target", F.col("enrichment").alias("value"))
    turned = result.join(p, (F.col("condition1") == F.col("w2")) & (F.col("condition2") == F.col("w1"))).select("w1", "w2", "source", "target", (-F.col("enrichment")).alias("other"))
    both = same.join(turned, ["w1", "w2", "source", "target"], "full")
    return both.select(F.col("w1").alias("condition1"), F.col("w2").alias("condition2"), "source", "target", F.coalesce("value", "other").alias("value"))


def boundaries(cells: DataFrame, polygons: DataFrame, sample: str, library_key: str = "sample", component_key: str = "component") -> tuple[DataFrame, DataFrame]:
    """(cells of one sample, polygons of the components that occur there)."""
    need(cells, library_key, component_key)
    own = cells.where(F.col(library_key) == sample)
    there = own.where(F.col(component_key).isNotNull()).select(F.col(component_key).cast("string").alias("component")).distinct()
    return own, polygons.join(there, "component", "left_semi")


plot_boundaries = boundaries


def shape_metrics(cells: DataFrame, metrics: DataFrame, condition_key: str | None = None, condition_groups: list[str] | None = None, cluster_key: str | None = None, cluster_groups: list[str] | None = None, component_key: str = "component", names: list[str] | None = None) -> DataFrame:
    """component (condition, cluster), metric, value: one row for each component and metric. metrics: component, metric, value."""
    keys = {"component": component_key, "condition": condition_key, "cluster": cluster_key}
    used = {k: v for k, v in keys.items() if v}
    need(cells, *used.values())
    rows = cells.select(*[F.col(v).cast("string").alias(k) for k, v in used.items()]).distinct().dropna()
    rows = rows.where(F.col("condition").isin(condition_groups)) if condition_groups else rows
    rows = rows.where(F.col("cluster").isin(cluster_groups)) if cluster_groups else rows
    wanted = metrics.where(F.col("metric").isin(names or ["linearity", "curl", "elongation", "purity", "rcs"]))
    return rows.join(wanted, "component")


def plot_shape_metrics(cells: DataFrame, metrics: DataFrame, **options) -> DataFrame:
    """Older name of shape_metrics, with fewer metrics by default."""
    return shape_metrics(cells, metrics, **{"names": ["linearity", "curl"], **options})


def plot_shapes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, q1, median, q3, low, high, n: the boxes of a box plot of `value`, with whiskers at the last values within 1.5 boxes of them.

    Values are counted first, so that a group's percentiles come from distinct values and their numbers.
    """
    counted = rows.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("m"))
    quart = counted.groupBy(*by).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("m")).alias("q"), F.sum("m").alias("n"))
    boxes = quart.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n").withColumn("reach", (F.col("q3") - F.col("q1")) * 1.5)
    near = counted.join(boxes.select(*by, (F.col("q1") - F.col("reach")).alias("least"), (F.col("q3") + F.col("reach")).alias("most")), by).where("value between least and most")
    return boxes.drop("reach").join(near.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high")), by).select(*by, "q1", "median", "q3", "low", "high", "n")


def outliers(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose value lies beyond the whiskers of its box, which a box plot shows as points."""
    return rows.join(plot_shapes(rows, by).select(*by, "low", "high"), by).where("value < low or value > high").drop("low", "high")


def autok_stability(mirrored: DataFrame) -> DataFrame:
    """k, stability, low, high: the mean stability and a 95 % band."""
    m = stability.mean_stability(mirrored)
    half = 1.96 * F.col("spread") / F.sqrt("n")
    return m.select("k", "stability", (F.col("stability") - half).alias("low"), (F.col("stability") + half).alias("high"))


def clip(rows: DataFrame, column: str, low: float | None = None, high: float | None = None, below: float | None = None, above: float | None = None) -> DataFrame:
    """Values outside [low, high] replaced (by the bounds themselves unless given)."""
    v = F.col(column)
    out = v
    if high is not None:
        out = F.when(v > high, F.lit(high if above is None else above)).otherwise(out)
    if low is not None:
        out = F.when(v < low, F.lit(low if below is None else below)).otherwise(out)
    return rows.withColumn(column, out)
