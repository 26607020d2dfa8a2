"""Neighbourhood enrichment of clusters, and its difference between conditions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichespark.functions.aggregates import log_ratio
from nichespark.functions.checks import need, with_params
from nichespark.operators.deal import deal, dealt_sums
from nichespark.operators.prune import with_labels
from nichespark.runtime import settle


def link_table(edges: DataFrame, labels: DataFrame, cluster: str, by: list[str] | None = None, only_inter: bool = False) -> DataFrame:
    """by, ls, ld, w: summed weights between labels; with only_inter without links inside a label. labels: cell_id, cluster."""
    marked = with_labels(edges.select("src", "dst", "weight", *(by or [])), labels, cluster)
    if only_inter:
        marked = marked.where(~F.coalesce(F.col("ls") == F.col("ld"), F.lit(False)))
    return marked.groupBy(*(by or []), "ls", "ld").agg(F.sum("weight").alias("w"))


def _enrich(links: DataFrame, sizes: DataFrame, domain: DataFrame, by: list[str], log: bool, only_inter: bool, symmetric: bool) -> DataFrame:
    """observed, expected and enrichment of every pair of the domain for each `by`.

    links: by, ls, ld, w. sizes: by, cluster (null too), n. domain: s, all labels (a small table).
    """
    all_cells = sizes.groupBy(*by).agg(F.sum("n").alias("nn")) if by else sizes.agg(F.sum("n").alias("nn"))
    all_links = links.groupBy(*by).agg(F.sum("w").alias("ww")) if by else links.agg(F.sum("w").alias("ww"))
    base = all_cells.join(all_links, by, "left") if by else all_cells.crossJoin(all_links)
    # labels times labels times conditions: small by nature
    grid = base.crossJoin(domain).crossJoin(domain.select(F.col("s").alias("t")))
    count = sizes.where("cluster is not null")
    a = count.select(*by, F.col("cluster").alias("s"), F.col("n").alias("ns"))
    b = count.select(*by, F.col("cluster").alias("t"), F.col("n").alias("nt"))
    total = links.groupBy(*by, F.col("ls").alias("s")).agg(F.sum("w").alias("row_w"))
    pair = links.where("ld is not null").select(*by, F.col("ls").alias("s"), F.col("ld").alias("t"), "w")
    grid = grid.join(a, [*by, "s"], "left").join(b, [*by, "t"], "left").join(total, [*by, "s"], "left").join(pair, [*by, "s", "t"], "left")
    ns, nt, nn, w = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("ns", "nt", "nn", "w"))
    d = F.coalesce(F.col("ww"), F.lit(0.0)) / nn  # mean weighted degree
    if symmetric:
        observed, expected = w, F.when(F.col("s") == F.col("t"), ns * nt * d / nn / 2.0).otherwise(ns * nt * d / nn)
    else:
        observed = F.try_divide(w, F.coalesce(F.col("row_w"), F.lit(0.0)))
        expected = F.when(d > 0, nt / nn)
    keep = F.col("s") != F.col("t") if only_inter else F.lit(True)
    value = log_ratio(observed, expected, True) if log else observed - expected
    return grid.select(*by, "s", "t", F.when(keep, observed).alias("observed"), F.when(keep, expected).alias("expected"), F.when(keep, value).alias("enrichment"), observed.alias("raw"))


def _domain(cells: DataFrame, key: str) -> DataFrame:
    return cells.select(F.col(key).cast("string").alias("s")).where("s is not null").distinct()


def permuted_links(cells: DataFrame, edges: DataFrame, cluster_key: str, n_perms: int, seed: int, only_inter: bool = True) -> DataFrame:
    """perm, ls, ld, w: summed weights between labels after dealing the labels anew (see deal).

    As in the observed table, links inside a label go by the labels as they are, ahead of the
    permutations. Edges join cells of the table.
    """
    used = edges.select("src", "dst", "weight")
    if only_inter:
        used = with_labels(used, cells, cluster_key).where(~F.coalesce(F.col("ls") == F.col("ld"), F.lit(False))).select("src", "dst", "weight")
    return dealt_sums(used, deal(cells, cluster_key, n_perms, seed), ["src", "dst"], weight="weight").select("perm", F.col("l0").alias("ls"), F.col("l1").alias("ld"), "w")


def _pvalues(rows: DataFrame, perms: DataFrame, by: list[str], n_perms: int) -> DataFrame:
    """pvalue: 1 - share of permutations below a positive (above a negative) `raw`; 1 at 0 and null. perms: by, s, t, perm, po."""
    joined = rows.select(*by, "s", "t", "raw").join(perms, [*by, "s", "t"], "left")
    hit = F.when(F.col("raw") > 0, F.col("po") < F.col("raw")).when(F.col("raw") < 0, F.col("po") > F.col("raw"))
    per = joined.groupBy(*by, "s", "t").agg(F.sum(hit.cast("long")).alias("hits"))
    p = 1 - F.coalesce(F.col("hits"), F.lit(0)).cast("double") / n_perms
    return rows.join(per, [*by, "s", "t"]).withColumn("pvalue", F.when(F.col("raw").isNull() | (F.col("raw") == 0), 1.0).otherwise(p))


def nhood_enrichment(
    cells: DataFrame,
    edges: DataFrame,
    cluster_key: str,
    log_fold_change: bool = False,
    only_inter: bool = True,
    symmetric: bool = False,
    pvalues: bool = False,
    n_perms: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """source, target, observed, expected, enrichment (and pvalue) of every pair of clusters.

    observed: weight of the links from source to target, as a share of all of source's links
    (unlabelled targets included) unless symmetric. expected: share of target among all cells, or
    with symmetric n_s * n_t * mean degree / N (half on the diagonal); with pvalues the mean over
    permutations. enrichment: the difference, or log2 of the ratio (-Infinity at 0). With
    only_inter, links inside a cluster go first, and the diagonal is null but for its p-value. The
    parameters are kept with the column enrichment (see params_of).
    """
    need(cells, "cell_id", cluster_key)
    need(edges, "src", "dst", "weight")
    labels = cells.select("cell_id", F.col(cluster_key).cast("string").alias("cluster"))
    links = settle(link_table(edges, labels, "cluster", only_inter=only_inter))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = _enrich(links, sizes, _domain(labels, "cluster"), [], log_fold_change, only_inter, symmetric)
    extra = []
    if pvalues:
        perm = permuted_links(labels, edges, "cluster", n_perms, seed, only_inter)
        total = F.sum("w").over(Window.partitionBy("perm", "ls"))
        po = F.col("w") if symmetric else F.try_divide(F.col("w"), total)
        each = perm.withColumn("po", po).where("ls is not null and ld is not null").select("perm", F.col("ls").alias("s"), F.col("ld").alias("t"), "po")
        ids = cells.sparkSession.range(n_perms).select(F.col("id").alias("perm"))
        full = rows.select("s", "t").crossJoin(ids).join(each.withColumn("perm", F.col("perm").cast("long")), ["s", "t", "perm"], "left").withColumn("po", F.coalesce("po", F.lit(0.0)))
        full = settle(full)
        rows = _pvalues(rows, full, [], n_perms)
        mean = full.groupBy("s", "t").agg(F.avg("po").alias("pe"))
        keep = F.col("s") != F.col("t") if only_inter else F.lit(True)
        value = log_ratio(F.col("raw"), F.col("pe"), True) if log_fold_change else F.col("raw") - F.col("pe")
        rows = rows.join(mean, ["s", "t"]).withColumns({"expected": F.when(keep, F.col("pe")), "enrichment": F.when(keep, value)})
        extra = ["pvalue"]
    out = rows.select(F.col("s").alias("source"), F.col("t").alias("target"), "observed", "expected", "enrichment", *extra)
    return with_params(out, cluster_key=cluster_key, log_fold_change=log_fold_change, only_inter=only_inter, symmetric=symmetric, pvalues=pvalues, n_perms=n_perms if pvalues else None, seed=seed if pvalues else None)


def _difference(rows: DataFrame, pairs: list[tuple[str, str]], by: str, value: str, more: list[str]) -> DataFrame:
    """value(first) - value(second) per pair of conditions, aligned by source and target."""
    spark = rows.sparkSession
    p = spark.createDataFrame(pairs, "condition1 string, condition2 string")
    keys = [*more, "s", "t"]
    a = rows.select(*keys, F.col(by).alias("condition1"), F.col(value).alias("v1"))
    b = rows.select(*keys, F.col(by).alias("condition2"), F.col(value).alias("v2"))
    return F.broadcast(p).join(a, "condition1").join(b, ["condition2", *keys]).select("condition1", "condition2", *keys, (F.col("v1") - F.col("v2")).alias("raw"))


def library_permutations(cells: DataFrame, condition_key: str, library_key: str, pairs: list[tuple[str, str]], n_perms: int, seed: int) -> DataFrame:
    """condition1, condition2, perm, library, side (1 or 2): libraries of a pair dealt anew, as many to each side as before."""
    libs = cells.select(F.col(condition_key).cast("string").alias("c"), F.col(library_key).cast("string").alias("library")).where("c is not null and library is not null").distinct()
    p = cells.sparkSession.createDataFrame(pairs, "condition1 string, condition2 string")
    of = F.broadcast(p).join(libs, (F.col("c") == F.col("condition1")) | (F.col("c") == F.col("condition2")))
    sized = of.withColumn("n1", F.sum(F.when(F.col("c") == F.col("condition1"), 1).otherwise(0)).over(Window.partitionBy("condition1", "condition2")))
    perm = sized.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
    spot = F.md5(F.concat(F.lit(f"{seed}|"), F.col("perm").cast("string"), F.lit("|"), F.col("library")))
    r = F.row_number().over(Window.partitionBy("condition1", "condition2", "perm").orderBy(spot, "library"))
    return perm.withColumn("side", F.when(r <= F.col("n1"), 1).otherwise(2)).select("condition1", "condition2", "perm", "library", "side")


def diff_nhood_enrichment(
    cells: DataFrame,
    edges: DataFrame,
    cluster_key: str,
    condition_key: str,
    condition_groups: list[str] | None = None,
    pvalues: bool = False,
    library_key: str = "sample",
    n_perms: int = 1000,
    seed: int = 0,
    log_fold_change: bool = False,
    only_inter: bool = True,
    symmetric: bool = False,
) -> DataFrame:
    """condition1, condition2, source, target, enrichment (and pvalue): enrichment(1) - enrichment(2).

    Every pair of conditions in the given (or sorted) order; a condition's graph is what lies
    inside it. With pvalues the libraries of a pair are dealt anew to its two sides: pvalue is 1 - the
    share of permutations with a smaller difference (larger for negative ones), 1 at 0. All
    permutations are one plan over link counts by pairs of libraries, not over edges.
    """
    need(cells, "cell_id", cluster_key, condition_key, library_key if pvalues else None)
    labels = cells.select("cell_id", F.col(cluster_key).cast("string").alias("cluster"), F.col(condition_key).cast("string").alias("cond"), *([F.col(library_key).cast("string").alias("lib")] if pvalues else []))
    groups = condition_groups or sorted(r[0] for r in labels.select("cond").where("cond is not null").distinct().collect())
    pairs = list(combinations([str(g) for g in groups], 2))
    domain = _domain(labels, "cluster")
    a = labels.select(F.col("cell_id").alias("src"), F.col("cond").alias("ca"), *([F.col("lib").alias("la")] if pvalues else []))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("cond").alias("cb"), *([F.col("lib").alias("lb")] if pvalues else []))
    ends = edges.select("src", "dst", "weight").join(a, "src").join(b, "dst")
    inside = ends.where("ca = cb").withColumnRenamed("ca", "cond")
    rows = _enrich(settle(link_table(inside, labels, "cluster", ["cond"], only_inter)), labels.where("cond is not null").groupBy("cond", "cluster").agg(F.count("*").alias("n")), domain, ["cond"], log_fold_change, only_inter, symmetric)
    out = _difference(rows, pairs, "cond", "enrichment", [])
    extra = []
    if pvalues:
        by_lib = settle(link_table(ends.where("la is not null and lb is not null"), labels, "cluster", ["la", "lb"], only_inter))
        lib_sizes = settle(labels.where("lib is not null").groupBy("lib", "cluster").agg(F.count("*").alias("n")))
        dealt = settle(library_permutations(labels, "cond", "lib", pairs, n_perms, seed))
        by = ["condition1", "condition2", "perm", "side"]
        left = dealt.withColumnRenamed("library", "la")
        right = dealt.select("condition1", "condition2", "perm", "side", F.col("library").alias("lb"))
        links = left.join(by_lib, "la").join(right, [*by, "lb"]).groupBy(*by, "ls", "ld").agg(F.sum("w").alias("w"))
        sizes = dealt.join(lib_sizes, dealt["library"] == lib_sizes["lib"]).groupBy(*by, "cluster").agg(F.sum("n").alias("n"))
        each = _enrich(links, sizes, domain, by, log_fold_change, only_inter, symmetric)
        k = ["condition1", "condition2", "perm", "s", "t"]
        one = each.where("side = 1").select(*k, F.col("enrichment").alias("v1"))
        two = each.where("side = 2").select(*k, F.col("enrichment").alias("v2"))
        perms = one.join(two, k).select("condition1", "condition2", "s", "t", (F.col("v1") - F.col("v2")).alias("po"))
        out = _pvalues(out, perms, ["condition1", "condition2"], n_perms)
        extra = ["pvalue"]
    out = out.select("condition1", "condition2", F.col("s").alias("source"), F.col("t").alias("target"), F.col("raw").alias("enrichment"), *extra)
    return with_params(out, cluster_key=cluster_key, condition_key=condition_key, condition_groups=groups, library_key=library_key if pvalues else None, log_fold_change=log_fold_change, only_inter=only_inter, symmetric=symmetric, pvalues=pvalues, n_perms=n_perms if pvalues else None, seed=seed if pvalues else None)
