"""Golden fixtures of the graph operators."""

import math

import numpy as np
import pytest

from nichespark import gr
from nichespark.functions.ranking import exact_percentile, global_rank
from nichespark.operators.khop import rings, simple_graph


def both(spark, pairs):
    rows = [(a, b, 1.0, None) for a, b in pairs] + [(b, a, 1.0, None) for a, b in pairs]
    return spark.createDataFrame(rows, "src long, dst long, weight double, dist double")


def cells(spark, clusters):
    return spark.createDataFrame([(i, c) for i, c in enumerate(clusters)], "cell_id long, cluster string")


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_delaunay_and_long_links(spark):
    c = spark.createDataFrame([(0, 1.0, 0.0), (1, 3.0, 0.0), (2, 5.0, 6.0), (3, 0.0, 4.0)], "cell_id long, x double, y double")
    e = gr.delaunay_edges(c)
    assert {p for p in pairs(e) if p[0] < p[1]} == {(0, 1), (0, 3), (1, 3), (2, 3), (1, 2)}
    kept = gr.remove_long_links(e, 50)
    assert {p for p in pairs(kept) if p[0] < p[1]} == {(0, 1), (0, 3), (1, 3)}
    assert kept.first()["radius"] == pytest.approx(5.0)


def test_long_links_keep_zero_and_null(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0.0), (0, 2, 1.0, None), (0, 3, 1.0, 9.0), (0, 4, 1.0, 1.0)], "src long, dst long, weight double, dist double")
    assert pairs(gr.remove_long_links(e, 10)) == {(0, 1), (0, 2), (0, 4)}


@pytest.mark.parametrize("labels, left", [((0, 0, 1, 1), {(0, 2), (0, 3), (1, 2), (1, 3)}), ((0, 0, 0, 0), set()), ((0, 1, 2, 3), {(i, j) for i in range(4) for j in range(i + 1, 4)}), ((None, None, 1, 1), {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)})])
def test_intra_links(spark, labels, left):
    e = spark.createDataFrame([(i, j, 1.0, 1.0) for i in range(4) for j in range(4)], "src long, dst long, weight double, dist double")
    c = cells(spark, [None if x is None else str(x) for x in labels])
    found = pairs(gr.remove_intra_cluster_links(e, c, "cluster"))
    assert {p for p in found if p[0] < p[1]} == left


@pytest.mark.parametrize("links, clusters, least, want", [([(0, 1), (2, 3)], None, 0, "0011"), ([(0, 1), (1, 3), (2, 3)], "0011", 0, "0011"), ([(0, 1), (0, 2), (2, 4), (3, 4)], "00011", 2, "00011"), ([(0, 1), (0, 2), (2, 4), (3, 4)], "00011", 3, "000--")])
def test_components(spark, links, clusters, least, want):
    c = cells(spark, list(clusters) if clusters else ["x"] * 4)
    got = gr.connected_components(c, both(spark, links), "cluster" if clusters else None, least).orderBy("cell_id").collect()
    assert "".join(r["component"] or "-" for r in got) == want


def test_components_of_a_long_path_and_lone_cells(spark):
    n = 300
    c = cells(spark, ["a"] * (n + 1))
    got = gr.connected_components(c, both(spark, [(i, i + 1) for i in range(n - 1)]), None, 1).collect()
    assert {r["component"] for r in got if r["cell_id"] < n} == {"0"} and [r["component"] for r in got if r["cell_id"] == n] == ["1"]


LINKS = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (2, 6), (2, 7), (3, 4), (3, 8), (6, 7)]


def test_khop(spark):
    c = spark.createDataFrame([(i, [2.0**i, 2.0 ** (8 - i)]) for i in range(9)], "cell_id long, features array<double>")
    out = gr.aggregate_neighbors(c, both(spark, LINKS), 2, ["mean", "var"])
    m = np.array([r["X_agg"] for r in out.orderBy("cell_id").collect()])
    assert m.shape == (9, 10)
    np.testing.assert_allclose(m[:, 2], [7.5, 16.5, 64.66, 91, 4.5, 2, 66, 34, 8], rtol=0.01)
    np.testing.assert_allclose(m[:, 3], [60, 132, 87.33, 91, 144, 128, 33, 34, 32], rtol=0.01)
    np.testing.assert_allclose(m[:, 4], np.square([5.36, 15.5, 51.85, 116.83, 3.5, 0, 62, 30, 0]), rtol=0.01)
    np.testing.assert_allclose(m[:, 6], [120, 9.33, 8.67, 3, 87.33, 1, 1, 1, 8.5], rtol=0.01)
    np.testing.assert_allclose(m[:, 8], np.square([85.79, 4.99, 5.73, 1.0, 119.27, 0, 0, 0, 7.5]), rtol=0.01)
    one = gr.aggregate_neighbors(c, both(spark, LINKS), 2, "mean").orderBy("cell_id").collect()
    many = gr.aggregate_neighbors(c, both(spark, LINKS), [2, 1, 0], ["mean"]).orderBy("cell_id").collect()
    assert one == many
    with pytest.raises(NotImplementedError):
        gr.aggregate_neighbors(c, both(spark, LINKS), 1, "median")


def test_khop_samples(spark):
    c = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [3.0]), (2, "b", [5.0]), (3, None, [7.0])], "cell_id long, sample string, features array<double>")
    out = gr.aggregate_neighbors(c, both(spark, [(0, 1), (1, 2), (2, 3)]), 1, sample_key="sample")
    assert {r["cell_id"]: r["X_agg"] for r in out.collect()} == {0: [1.0, 3.0], 1: [3.0, 1.0], 2: [5.0, 0.0], 3: None}


def test_rings_are_shortest_paths(spark):
    hops = rings(simple_graph(both(spark, [(0, 1), (1, 2), (2, 3), (0, 2)])), 3)
    assert [pairs(h) for h in hops][1] == {(0, 3), (3, 0), (1, 3), (3, 1)} and not pairs(hops[2])


def test_percentile_and_rank(spark):
    x = np.random.default_rng(0).random(1001)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for q in (0, 0.01, 0.5, 0.99, 1):
        assert exact_percentile(df, "v", q) == pytest.approx(np.quantile(x, q), abs=1e-12)
    got = [r["rank"] for r in global_rank(df, ["v"]).orderBy("v").collect()]
    assert got == list(range(1001))


def test_knn_is_exact(spark):
    p = np.random.default_rng(1).normal(size=(300, 2)) ** 3
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "cell_id long, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, math.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i], kind="stable")[:5]}
    assert pairs(gr.knn_edges(c, 5, symmetric=False)) == want


def test_radius(spark):
    p = np.random.default_rng(2).random((200, 2))
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "cell_id long, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    assert pairs(gr.radius_edges(c, 0.1)) == {(i, j) for i, j in zip(*np.nonzero(d <= 0.1)) if i != j}


def test_components_with_a_hub(spark):
    # a star of 3,000, chains that hang on it, and a part of its own
    links = [(0, i) for i in range(1, 3001)] + [(i, i + 10_000) for i in range(1, 3001, 7)] + [(50_000, 50_001)]
    from nichespark.operators.star import star_components

    e = spark.createDataFrame([(b, a) for a, b in links], "src long, dst long")
    got = {r["node"]: r["component"] for r in star_components(e).collect()}
    assert got == {n: 50_000 if n >= 50_000 else 0 for pair in links for n in pair}
