"""Queries over the benchmark tables, one or more for every operator."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichespark.operators import build, components, group, khop, nhood, prune, shape
from nichespark.operators import stability as st
from nichespark.operators.autok import ClusterAutoK
from nichespark.operators.gmm import Cluster, GaussianMixture, Mixture
from nichespark.plans import figures
from nichespark.sources import tables as t
from nichespark.streaming.shares import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Component polygons for the shape queries: component, then rings of corners.
RINGS: dict[str, list[list[tuple[float, float]]]] = {
    "0": [[(-0.2, -0.5), (-0.2, 0.5), (0.0, 0.5), (0.0, -0.5)]],
    "1": [[(-0.6, -0.1), (-0.6, 0.1), (-0.1, 0.1), (-0.1, 0.6), (0.1, 0.6), (0.1, 0.1), (0.6, 0.1), (0.6, -0.1), (0.1, -0.1), (0.1, -0.6), (-0.1, -0.6), (-0.1, -0.1)]],
    "2": [[(-0.5, -0.5), (0.5, -0.5), (0.5, -0.3), (-0.3, -0.3), (-0.3, 0.5), (-0.5, 0.5)]],
    "3": [[(-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25)], [(-0.1, -0.1), (-0.1, 0.1), (0.1, 0.1), (0.1, -0.1)]],
}
NHOOD = [(sym, inter, log) for sym, inter, log in product((False, True), repeat=3)]


def nhood_name(symmetric: bool, only_inter: bool, log: bool) -> str:
    return f"nhood_{'sym' if symmetric else 'asym'}_{'inter' if only_inter else 'all'}_{'log2' if log else 'diff'}"


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(c, [[(float(x), float(y)) for x, y in r] for r in rings]) for c, rings in RINGS.items()]
    return spark.createDataFrame(rows, f"component string, rings {shape.RINGS}")


def _cust(spark, d):
    return (c := t.cells_cust(spark, d)), build.lattice_edges(c)


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _finite(name: str, digits: int = 4):
    """Rounded, null for infinities, so that all engines agree."""
    return F.when(F.abs(name) != float("inf"), F.round(name, digits)).alias(name)


def lattice_edges(spark, d):
    return _cust(spark, d)[1].select("src", "dst", "weight", "dist")


def lattice_edges_diagonal_by_sample(spark, d):
    return build.lattice_edges(t.cells_cust(spark, d), sample="sample", diagonal=True).select("src", "dst", *_r("dist"))


def knn_edges(spark, d):
    return build.knn_edges(t.cells_emb(spark, d), 6).select("src", "dst", *_r("dist"))


def radius_edges(spark, d):
    return build.radius_edges(t.cells_emb(spark, d), 0.02).select("src", "dst", *_r("dist"))


def _long(p):
    def run(spark, d):
        return prune.remove_long_links(build.knn_edges(t.cells_emb(spark, d), 6), p).select("src", "dst", *_r("dist", "radius"))

    return run


def remove_intra_cluster_links(spark, d):
    c, e = _cust(spark, d)
    return prune.remove_intra_cluster_links(e, c, "cluster").select("src", "dst", "dist")


def khop_degree_l1_l3(spark, d):
    _, e = _cust(spark, d)
    hops = khop.rings(khop.simple_graph(e), 3)
    parts = [h.groupBy(F.col("src").alias("cell_id")).agg(F.count("*").alias("n")).withColumn("layer", F.lit(i + 1)) for i, h in enumerate(hops)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("cell_id", "layer", "n")


def _agg(layers, aggs, sample=None, emb=False):
    def run(spark, d):
        if emb:
            c = t.cells_emb(spark, d)
            e = build.knn_edges(c, 4)
        else:
            c, e = _cust(spark, d)
            c = c.withColumn("features", F.array("value"))
        out = khop.aggregate_neighbors(c, e, layers, aggs, sample_key=sample, out_type="double")
        # the shift keeps means of a few amounts off the middle between two rounded values
        return out.select("cell_id", F.posexplode("X_agg").alias("pos", "value")).select("cell_id", "pos", F.round(F.col("value") + 1.234567e-7, 3).alias("value"))

    return run


def _proportion(normalize):
    return lambda spark, d: group.proportion(t.cells_evt(spark, d), "grp", "cluster", normalize).select("id", "val", *_r("value"))


def _enrichment(log):
    def run(spark, d):
        out = group.enrichment(t.cells_evt(spark, d), "grp", "cluster", log=log)
        return out.select("group", "label", *_r("observed", "expected"), _finite("enrichment"))

    return run


def enrichment_perm_pvalue(spark, d):
    out = group.enrichment(t.cells_cust(spark, d), "condition", "cluster", pvalues=True, n_perms=20, seed=1, log=False)
    return out.select("group", "label", *_r("observed", "expected", "pvalue"), _finite("enrichment"))


def enrichment_pvalue(spark, d):
    out = group.enrichment(t.cells_cust(spark, d), "condition", "cluster", pvalues=True, n_perms=1000, seed=1)
    return out.select("group", "label", *_r("observed", "expected", "pvalue"), _finite("enrichment"))


def _nhood(sym, inter, log):
    def run(spark, d):
        c, e = _cust(spark, d)
        out = nhood.nhood_enrichment(c, e, "cluster", log_fold_change=log, only_inter=inter, symmetric=sym)
        return out.select("source", "target", *_r("observed", "expected"), _finite("enrichment"))

    return run


def nhood_orders(spark, d):
    c = t.cells_ord(spark, d)
    return nhood.nhood_enrichment(c, build.lattice_edges(c), "cluster").select("source", "target", *_r("observed", "expected", "enrichment"))


def nhood_perm_pvalue(spark, d):
    c, e = _cust(spark, d)
    out = nhood.nhood_enrichment(c, e, "cluster", pvalues=True, n_perms=20, seed=1)
    return out.select("source", "target", *_r("observed", "expected", "enrichment", "pvalue"))


def nhood_pvalue(spark, d):
    c, e = _cust(spark, d)
    out = nhood.nhood_enrichment(c, e, "cluster", pvalues=True, n_perms=1000, seed=1)
    return out.select("source", "target", *_r("observed", "expected", "enrichment", "pvalue"))


def diff_nhood_pairs(spark, d):
    c = t.cells_ord(spark, d)
    out = nhood.diff_nhood_enrichment(c, build.lattice_edges(c), "cluster", "condition")
    return out.select("condition1", "condition2", "source", "target", *_r("enrichment"))


def diff_nhood_perm_pvalue(spark, d):
    c, e = _cust(spark, d)
    out = nhood.diff_nhood_enrichment(c, e, "cluster", "condition", pvalues=True, n_perms=1000, seed=1)
    return out.select("condition1", "condition2", "source", "target", *_r("enrichment", "pvalue"))


def _components(cluster, min_cells):
    def run(spark, d):
        c = t.cells_cust(spark, d)
        return components.connected_components(c, build.lattice_edges(c, sample=None if cluster else "sample"), cluster, min_cells)

    return run


def _with_components(spark, d):
    c, e = _cust(spark, d)
    return c.join(components.connected_components(c, e, "cluster", 3), "cell_id")


def _rcs(library):
    def run(spark, d):
        out = shape.relative_component_size_metric(_with_components(spark, d), "cluster", library_key=library)
        return out.select("component", "neighborhood", *(["library"] if library else []), *_r("value"))

    return run


def fmi_matrix(spark, d):
    return st.fowlkes_mallows(st.contingency(t.runs(spark, d))).select("k", "run_a", "run_b", *_r("value"))


def ari_pairs(spark, d):
    return st.adjusted_rand(st.same_k_pairs(t.runs(spark, d))).select("k", "run_a", "run_b", *_r("value"))


def _mirrored(spark, d):
    return st.mirror(st.fowlkes_mallows(st.contingency(t.runs(spark, d))))


def stability_mirror(spark, d):
    return _mirrored(spark, d).select("k", "part", "run_a", "run_b", *_r("value"))


def best_k(spark, d):
    return st.best_k(st.mean_stability(_mirrored(spark, d)).withColumn("stability", F.round("stability", 6)))


def stability_peaks(spark, d):
    scores = st.fowlkes_mallows(st.contingency(t.runs(spark, d, ks=(2, 8), agreed=(4, 6))))
    return st.peaks(st.mean_stability(st.mirror(scores)).withColumn("stability", F.round("stability", 6)))


def stability_mape(spark, d):
    r = t.runs(spark, d)
    a = st.mean_stability(st.fowlkes_mallows(st.contingency(r.where("run < 3"))))
    b = st.mean_stability(st.fowlkes_mallows(st.contingency(r)))
    return st.mape(a, b).select(*_r("mape"))


def polygon_area_perimeter(spark, d):
    return shape.area_perimeter(polygons(spark)).select("component", *_r("area", "perimeter"))


def curl(spark, d):
    return shape.curl_metric(polygons(spark)).select("component", "metric", *_r("value"))


def elongation_hull_axes(spark, d):
    return shape.elongation_metric(polygons(spark)).select("component", "metric", *_r("value"))


def linearity(spark, d):
    return shape.linearity_metric(polygons(spark), height=400)


def _purity(exterior):
    return lambda spark, d: shape.purity_metric(t.cells_emb(spark, d), polygons(spark), "cluster", "sample", exterior).select("component", "metric", *_r("value"))


def alpha_shape_boundaries(spark, d):
    found = shape.boundaries(t.cells_emb(spark, d), "cluster", alpha_start=0.05)
    return found.select("component", F.size("rings").alias("n_rings"), F.size(F.col("rings")[0]).alias("n_corners"))


def boundaries_wkb(spark, d):
    back = shape.from_wkb(shape.with_wkb(polygons(spark)))
    return shape.ring_table(back).select("component", "ring", "seq", "x1", "y1", "x2", "y2")


def delaunay_edges(spark, d):
    return build.delaunay_edges(t.cells_emb(spark, d), "sample").select("src", "dst", *_r("dist"))


def gmm_k1_moments(spark, d):
    m = GaussianMixture(1).fit(t.cells_emb(spark, d, 3)).model_
    rows = [(i, j, float(m.means[0][i]), float(m.covariances[0][i][j])) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "i int, j int, mean double, cov double").select("i", "j", *_r("mean", "cov"))


#: Where the two components of gmm_em_steps start.
EM_MEANS, EM_STEPS = ((-0.1, 0.0), (0.1, 0.05)), 3


def gmm_em_steps(spark, d):
    """Three steps of EM with full covariances from given means: exact figures that SQL can follow."""
    fitted = GaussianMixture(2, init_means=EM_MEANS, convergence_tolerance=0.0, trainer_params={"max_epochs": EM_STEPS}).fit(t.cells_emb(spark, d, 2))
    m = fitted.model_
    rows = [(i, fitted.nll_, float(m.weights[i]), *map(float, m.means[i]), float(m.covariances[i][0][0]), float(m.covariances[i][0][1]), float(m.covariances[i][1][1])) for i in range(2)]
    return spark.createDataFrame(rows, "k int, nll double, w double, mx double, my double, cxx double, cxy double, cyy double").select("k", *_r("nll", "w", "mx", "my", "cxx", "cxy", "cyy"))


def gmm_scores(spark, d):
    """Posteriors, scores and labels under a model of given parameters."""
    model = GaussianMixture(2)
    model.model_ = Mixture(np.array([0.4, 0.6]), np.array(EM_MEANS), np.array([[[0.02, 0.005], [0.005, 0.03]], [[0.03, 0.0], [0.0, 0.01]]]))
    c = t.cells_emb(spark, d, 2)
    out = model.score_samples(model.predict_proba(model.predict(c)))
    return out.select("cell_id", "cluster", F.round(F.col("proba")[0], 6).alias("p0"), *_r("nll"))


def gmm_fit_predict(spark, d):
    c = t.cells_emb(spark, d)
    return Cluster(4, random_state=0).fit(c, "features").predict(c, "features", "label").select("cell_id", "label")


def autok_fit(spark, d):
    auto = ClusterAutoK((2, 3), max_runs=2, model_params={"covariance_type": "diag", "convergence_tolerance": 0.05})
    auto.fit(t.cells_emb(spark, d, 4))
    return auto.mirrored()


def enrichment_dotplot_table(spark, d):
    out = figures.enrichment(group.enrichment(t.cells_evt(spark, d), "grp", "cluster"), size_threshold=0.05, group_cluster=False)
    return out.select("group", "label", *_r("value", "size", "color", digits=4))


def enrichment_dotplot_significance(spark, d):
    found = group.enrichment(t.cells_cust(spark, d), "condition", "cluster", pvalues=True, n_perms=20, seed=1, log=False)
    out = figures.enrichment(found, significance=0.5, enriched_only=False, group_cluster=False)
    return out.select("group", "label", *_r("value", "size", "color", digits=4))


def proportion_table(spark, d):
    return figures.proportion(t.cells_evt(spark, d), "grp", "cluster", groups=["1", "2", "3"]).select("id", "val", "position", *_r("value"))


def nhood_heatmap_table(spark, d):
    c, e = _cust(spark, d)
    out = nhood.nhood_enrichment(c, e, "cluster", pvalues=True, n_perms=20, seed=1)
    return figures.nhood_enrichment(out, c, "cluster", min_freq=0.19, transpose=True, significance=0.05, n_digits=3)


def diff_heatmap_negated(spark, d):
    c = t.cells_ord(spark, d)
    out = nhood.diff_nhood_enrichment(c, build.lattice_edges(c), "cluster", "condition", condition_groups=["F", "O", "P"])
    return figures.diff_nhood_enrichment(out, [("O", "F"), ("F", "P")]).select("condition1", "condition2", "source", "target", *_r("value"))


def shape_metrics_long(spark, d):
    m = shape.curl_metric(polygons(spark)).unionByName(shape.elongation_metric(polygons(spark)))
    out = figures.shape_metrics(t.cells_emb(spark, d).withColumn("component", F.col("cluster")), m, condition_key="sample")
    return out.select("component", "condition", "metric", *_r("value"))


def shape_boxes(spark, d):
    rows = t.cells_cust(spark, d).select("cluster", "value")
    return figures.plot_shapes(rows, ["cluster"]).select("cluster", *_r("q1", "median", "q3", "low", "high", digits=4), "n")


def stability_curve(spark, d):
    return figures.autok_stability(_mirrored(spark, d)).select("k", *_r("stability", "low", "high"))


def boundary_plot_components(spark, d):
    c = t.cells_emb(spark, d).withColumn("component", F.col("cluster"))
    return figures.boundaries(c, polygons(spark), "1")[1].select("component", F.size("rings").alias("n_rings"))


def windowed_label_counts(spark, d):
    return windowed_counts(t.cells_evt(spark, d), "cluster", window="1 day").select("start", "cluster", "n")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in (lattice_edges, lattice_edges_diagonal_by_sample, knn_edges, radius_edges, delaunay_edges, remove_intra_cluster_links, khop_degree_l1_l3)}
    out |= {"remove_long_links_p99": _long(99.0), "remove_long_links_p50": _long(50.0)}
    out |= {"aggregate_neighbors_mean_l2": _agg(2, "mean"), "aggregate_neighbors_var_l2": _agg(2, "var"), "aggregate_neighbors_mean_var_l3": _agg([0, 1, 3], ["mean", "var"]), "aggregate_neighbors_by_sample": _agg(1, ["mean"], "sample"), "aggregate_neighbors_embeddings": _agg(1, "mean", None, True)}
    out |= {"proportion_norm": _proportion(True), "proportion_counts": _proportion(False), "enrichment_log2": _enrichment(True), "enrichment_fc": _enrichment(False)}
    out |= {f.__name__: f for f in (enrichment_perm_pvalue, enrichment_pvalue, nhood_orders, nhood_perm_pvalue, nhood_pvalue, diff_nhood_pairs, diff_nhood_perm_pvalue)}
    out |= {nhood_name(*v): _nhood(*v) for v in NHOOD}
    out |= {"connected_components_all": _components(None, 0), "connected_components_by_cluster": _components("cluster", 0), "connected_components_min_cells": _components("cluster", 4), "rcs": _rcs(None), "rcs_by_library": _rcs("condition")}
    out |= {f.__name__: f for f in (fmi_matrix, ari_pairs, stability_mirror, best_k, stability_peaks, stability_mape, polygon_area_perimeter, curl, elongation_hull_axes, linearity, alpha_shape_boundaries, boundaries_wkb)}
    out |= {"purity": _purity(False), "purity_exterior": _purity(True)}
    out |= {f.__name__: f for f in (gmm_k1_moments, gmm_em_steps, gmm_scores, gmm_fit_predict, autok_fit, enrichment_dotplot_table, enrichment_dotplot_significance, proportion_table, nhood_heatmap_table, diff_heatmap_negated, shape_metrics_long, shape_boxes, stability_curve, boundary_plot_components, windowed_label_counts)}
    return out
