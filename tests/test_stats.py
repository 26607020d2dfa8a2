"""Invariants and closed forms of the statistics."""

import numpy as np
import pytest

from nichespark import gr, pl, tl
from nichespark.operators import stability as st
from nichespark.operators.geometry import component_rings, convex_hull, curl, delaunay, elongation, from_wkb, linearity, ring_area, to_wkb
from nichespark.operators.shape import area_perimeter, ring_table


@pytest.fixture(scope="module")
def tissue(spark):
    rng = np.random.default_rng(3)
    rows = [(20 * y + x, x, y, str(rng.integers(3)) if rng.random() > 0.05 else None, str(x % 2), str(y % 5)) for x in range(20) for y in range(20)]
    c = spark.createDataFrame(rows, "cell_id long, gx long, gy long, cluster string, condition string, sample string").cache()
    return c, gr.lattice_edges(c).cache()


def test_enrichment_ranges(tissue):
    c, e = tissue
    out = gr.nhood_enrichment(c, e, "cluster", only_inter=False).toPandas()
    assert len(out) == 9 and out["enrichment"].between(-1, 1).all() and out["observed"].between(0, 1).all() and out["expected"].between(0, 1).all()


def test_symmetric(tissue):
    c, e = tissue
    m = gr.nhood_enrichment(c, e, "cluster", symmetric=True, only_inter=False).toPandas().pivot(index="source", columns="target", values="enrichment").to_numpy()
    np.testing.assert_allclose(m, m.T)


def test_diagonal_is_null(tissue):
    c, e = tissue
    out = gr.nhood_enrichment(c, e, "cluster").toPandas()
    assert out.loc[out["source"] == out["target"], ["enrichment", "observed", "expected"]].isna().all().all()


def test_permutations_agree_with_the_closed_form(tissue):
    c, e = tissue
    a = gr.nhood_enrichment(c, e, "cluster", only_inter=False).toPandas().set_index(["source", "target"]).sort_index()
    b = gr.nhood_enrichment(c, e, "cluster", only_inter=False, pvalues=True, n_perms=60).toPandas().set_index(["source", "target"]).sort_index()
    np.testing.assert_allclose(a["enrichment"], b["enrichment"], atol=0.1)
    assert b["pvalue"].between(0, 1).all()


def test_group_permutations_agree(tissue):
    c, _ = tissue
    a = gr.enrichment(c, "cluster", "condition").toPandas().set_index(["group", "label"]).sort_index()
    b = gr.enrichment(c, "cluster", "condition", pvalues=True, n_perms=60).toPandas().set_index(["group", "label"]).sort_index()
    # with permutations, unlabelled cells are in no share
    np.testing.assert_allclose(a["observed"], b["observed"])
    np.testing.assert_allclose(a["expected"], b["expected"], atol=0.1)
    assert b["pvalue"].between(0, 1).all()


def test_parameters_stay_with_the_result(tissue, spark, tmp_path):
    from nichespark.functions.checks import params_of

    c, e = tissue
    out = gr.nhood_enrichment(c, e, "cluster", pvalues=True, n_perms=5, seed=2)
    out.write.parquet(f"file://{tmp_path}/kept")
    for df in (out, spark.read.parquet(f"file://{tmp_path}/kept")):
        assert params_of(df) == {"cluster_key": "cluster", "log_fold_change": False, "only_inter": True, "symmetric": False, "pvalues": True, "n_perms": 5, "seed": 2}
    assert "n_perms" not in params_of(gr.nhood_enrichment(c, e, "cluster")) and params_of(gr.enrichment(c, "cluster", "condition"))["label_key"] == "condition"


def test_dealing_keeps_every_label_as_often_as_it_is(tissue):
    from nichespark.operators.deal import deal

    c, _ = tissue
    dealt = deal(c, "cluster", 40, 3)
    ids = np.array([r[0] for r in c.select("cell_id").collect()], np.int64)
    codes = np.array([dealt.codes(ids, p) for p in range(40)])
    for row in codes:
        assert np.bincount(row, minlength=len(dealt.labels)).tolist() == dealt.counts
    # all permutations differ, and a cell gets every label at some time
    assert len({tuple(row) for row in codes}) == 40
    assert all(len(set(column)) > 1 for column in codes.T)


def test_diff(tissue):
    c, e = tissue
    out = gr.diff_nhood_enrichment(c, e, "cluster", "sample").toPandas()
    assert out.groupby(["condition1", "condition2"]).ngroups == 10
    with pytest.raises(KeyError):
        gr.diff_nhood_enrichment(c, e, "cluster", "nothing")
    with pytest.raises(KeyError):
        gr.diff_nhood_enrichment(c, e, "nothing", "sample")
    p = gr.diff_nhood_enrichment(c, e, "cluster", "condition", pvalues=True, n_perms=10).toPandas()
    assert p["pvalue"].between(0, 1).all()
    turned = pl.diff_nhood_enrichment(gr.diff_nhood_enrichment(c, e, "cluster", "condition"), [("1", "0")]).toPandas()
    assert len(turned) == 9


def test_figure_errors(tissue):
    c, _ = tissue
    plain = gr.enrichment(c, "cluster", "condition")
    with pytest.raises(ValueError):
        pl.enrichment(plain, show_pvalues=True)
    with pytest.raises(ValueError):
        pl.enrichment(plain, groups=["missing"])
    assert pl.enrichment(plain, enriched_only=False).count() == 6


RECT = [(0, 0), (0, 10), (2, 10), (2, 0)]


def plus(arm):
    a, b, end = 5, 5 + arm, 10 + arm
    return [(0, a), (0, b), (a, b), (a, end), (b, end), (b, b), (end, b), (end, a), (b, a), (b, 0), (a, 0), (a, a)]


def test_closed_forms():
    assert linearity([RECT]) == 1.0
    assert linearity([plus(2)]) == pytest.approx(0.5, abs=0.01)
    assert linearity([plus(1)]) == pytest.approx(linearity([plus(2)]), abs=0.01)
    assert elongation([RECT]) == pytest.approx(0.8) and curl([RECT]) == pytest.approx(0)
    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert elongation([square]) == pytest.approx(0) and curl([square]) == pytest.approx(0)
    assert from_wkb(to_wkb([RECT, square])) == [RECT, square]


def test_boundaries_purity(spark):
    rng = np.random.default_rng(5)
    inner, outer = rng.random((400, 2)), rng.random((300, 2)) + [3, 0]
    rows = [(i, "0", "s", float(x), float(y)) for i, (x, y) in enumerate(inner)] + [(1000 + i, "1", "s", float(x), float(y)) for i, (x, y) in enumerate(outer)] + [(5000, None, "s", 0.5, 0.5)]
    c = spark.createDataFrame(rows, "cell_id long, component string, sample string, x double, y double")
    polygons = tl.boundaries(c, alpha_start=0.2).cache()
    assert {r["component"] for r in polygons.collect()} == {"0", "1"}
    area = {r["component"]: r["area"] for r in area_perimeter(polygons).collect()}
    assert 0.85 < area["0"] < 1 and 0.85 < area["1"] < 1
    value = {r["component"]: r["value"] for r in tl.purity_metric(c, polygons).collect()}
    assert value["1"] == 1.0 and 0.99 < value["0"] < 1.0
    assert ring_table(polygons).count() > 20
    with pytest.warns(FutureWarning):
        assert tl.elongation(polygons).count() == 2


CLOSE = np.random.default_rng(0).random((120, 2)) * np.repeat([1, 1e-4], 60)[:, None] + np.repeat([0, 0.5], 60)[:, None]
CIRCLE = np.column_stack([np.cos(np.arange(40) * np.pi / 20), np.sin(np.arange(40) * np.pi / 20)])


@pytest.mark.parametrize("points", [CLOSE, CIRCLE, np.argwhere(np.ones((12, 12))) * 0.1 + np.random.default_rng(1).normal(0, 1e-9, (144, 2)), np.vstack([CLOSE, CLOSE[::-1], [[np.nan, 0], [0, np.inf]]])])
def test_triangles_cover_the_hull_once(points):
    t = delaunay(points)
    whole = ring_area([tuple(p) for p in convex_hull(points[np.isfinite(points).all(axis=1)])])
    each = [ring_area([tuple(points[i]) for i in x]) for x in t]
    assert sum(each) == pytest.approx(whole, rel=1e-12) and min(each) > 0
    sides = np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]])
    assert len(np.unique(sides, axis=0)) == len(sides)
    assert len(delaunay(np.column_stack([np.arange(9.0)] * 2))) == 0 == len(delaunay(np.zeros((0, 2))))


def test_boundaries_of_close_cells(spark):
    rows = [(i, "0", float(x), float(y)) for i, (x, y) in enumerate(CLOSE)]
    found = tl.boundaries(spark.createDataFrame(rows, "cell_id long, component string, x double, y double"), alpha_start=0.05).collect()
    shell = found[0]["rings"][0]
    assert len(found) == 1 and len({(p["x"], p["y"]) for p in shell}) == len(shell) > 5


def test_rings_that_touch():
    square = np.argwhere(np.ones((4, 4))).astype(float)
    rings = component_rings(np.vstack([square, square + 3]), alpha_start=1)
    assert len(rings) == 1 and len(set(rings[0])) == len(rings[0]) and ring_area(rings[0]) > 18  # two squares share one point: not one polygon yet
    x, y = (grid := np.argwhere(np.ones((13, 13))).astype(float)).T
    away = np.maximum(abs(x - 6), abs(y - 6))
    areas = lambda keep: [ring_area(r) for r in component_rings(grid[keep], alpha_start=1)]
    band = away > 4
    assert areas(band | (away < 2)) == [144, -98]  # what lies in a hole is no polygon of its own
    assert areas(band & ((x != 1) | (y != 6))) == [144, -99]  # the hole touches the outline
    assert areas(band & (((x != 1) & (x != 11)) | (y != 6))) == [144]  # twice, and would cut the polygon


def test_relative_component_size(spark):
    shares = [("0", "c0", 40), ("1", "c1", 21), ("1", "c2", 14)]
    rows = [(d, k) for d, k, n in shares for _ in range(n)]
    c = spark.createDataFrame(rows, "domain string, component string")
    got = {r["component"]: r["value"] for r in tl.relative_component_size_metric(c, "domain").collect()}
    assert got == pytest.approx({"c0": 1.0, "c1": 1.2, "c2": 0.8})


def test_similarity_scores(spark):
    a, b = [0, 0, 1, 1, 2, 2], [0, 0, 1, 2, 2, 2]
    rows = [(1, 2, i, x) for i, x in enumerate(a)] + [(0, 2, i, x) for i, x in enumerate(b)]
    table = st.same_k_pairs(spark.createDataFrame(rows, "run int, k int, cell_id long, label int"))
    assert st.fowlkes_mallows(table).first()["value"] == pytest.approx(2 / np.sqrt(3 * 4))
    assert st.adjusted_rand(table).first()["value"] == pytest.approx((2 - 12 / 15) / (3.5 - 12 / 15))


def test_peaks_and_best(spark):
    m = spark.createDataFrame([(2, 0.1), (3, 0.5), (4, 0.5), (5, 0.2), (6, 0.5), (7, 0.1)], "k int, stability double")
    assert sorted(r["k"] for r in st.peaks(m).collect()) == [3, 6] and st.best_k(m).first()["k"] == 3


def test_mixture(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.3, (150, 2)), rng.normal(4, 0.5, (100, 2))])
    c = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, features array<double>")
    m = tl.GaussianMixture(2).fit(c)
    labels = [r["cluster"] for r in m.predict(c).orderBy("cell_id").collect()]
    assert len(set(labels[:150])) == 1 and len(set(labels[150:])) == 1 and labels[0] != labels[-1]
    assert np.allclose([sum(r["proba"]) for r in m.predict_proba(c).collect()], 1)
    nll = np.mean([r["nll"] for r in m.score_samples(c).collect()])
    assert nll == pytest.approx(m.nll_, abs=0.05)
    m.save(spark, f"file://{tmp_path}/m")
    assert np.allclose(tl.GaussianMixture.load(spark, f"file://{tmp_path}/m").model_.means, m.model_.means)
    one = tl.GaussianMixture(1).fit(c).model_
    assert np.allclose(one.means[0], x.mean(0)) and np.allclose(one.covariances[0], np.cov(x.T, bias=True) + 1e-6 * np.eye(2))
    with pytest.raises(ImportError):
        tl.TRVAE()
    auto = tl.ClusterAutoK((2, 2), max_runs=2, model_params={"covariance_type": "diag"}).fit(c)
    assert auto.best_k == 2 and {r["cluster"] for r in auto.predict(c).collect()} == {"0", "1"}
    auto.save(f"file://{tmp_path}/a")
    assert tl.ClusterAutoK.load(spark, f"file://{tmp_path}/a").best_k == 2


def test_mixture_is_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.4, (120, 3)), rng.normal(3, 0.4, (90, 3))])
    c = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    start = {"init_means": [[0.0] * 3, [3.0] * 3]}
    here, there = tl.GaussianMixture(2, **start).fit(c.coalesce(1)), tl.GaussianMixture(2, batch_size=7, **start).fit(c.repartition(5))
    assert here.num_iter_ == there.num_iter_ and here.converged_
    np.testing.assert_allclose(here.model_.means, there.model_.means)
    np.testing.assert_allclose(here.model_.covariances, there.model_.covariances, atol=1e-9)
    one = tl.GaussianMixture(2, trainer_params={"max_epochs": 1}, **start).fit(c)
    assert one.num_iter_ == 1 and not one.converged_


def test_mixture_of_few_distinct_rows_has_a_start(spark, monkeypatch):
    from nichespark.operators import gmm

    monkeypatch.setattr(gmm, "INIT_ROWS", 50)
    rows = spark.range(3000).selectExpr("array(cast(id % 2 as double) * 4 + id % 3 * 1e-3, 1.0 + id % 5 * 1e-3) features")
    found = tl.GaussianMixture(2, random_state=3).fit(rows)
    np.testing.assert_allclose(sorted(found.model_.means[:, 0]), [0.001, 4.001], atol=0.01)
