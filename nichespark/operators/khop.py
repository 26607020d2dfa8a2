"""Features of cells aggregated over the rings of their graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.functions.aggregates import aggregate
from nichespark.functions.checks import as_list, need
from nichespark.runtime import settle


def simple_graph(edges: DataFrame, cells: DataFrame | None = None, sample_key: str | None = None) -> DataFrame:
    """Distinct src, dst without self-loops and, given samples, without edges between two of them."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    if cells is None or sample_key is None:
        return plain
    need(cells, sample_key)
    of = cells.select("cell_id", F.col(sample_key).alias("s")).where("s is not null")
    a, b = of.select(F.col("cell_id").alias("src"), F.col("s").alias("sa")), of.select(F.col("cell_id").alias("dst"), F.col("s").alias("sb"))
    return plain.join(a, "src").join(b, "dst").where("sa = sb").select("src", "dst")


def rings(graph: DataFrame, layers: int) -> list[DataFrame]:
    """For each layer from 1: src, dst at a shortest path of exactly that many edges."""
    graph = settle(graph) if layers > 1 else graph
    out, frontier, visited = [graph], graph, graph
    for _ in range(1, layers):
        step = frontier.join(graph.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").where("src <> far").select("src", F.col("far").alias("dst")).distinct()
        frontier = settle(step.join(visited, ["src", "dst"], "left_anti"))
        visited = visited.unionByName(frontier)
        out.append(frontier)
    return out


def aggregate_neighbors(
    cells: DataFrame,
    edges: DataFrame,
    n_layers: int | list[int],
    aggregations: str | list[str] = "mean",
    use_rep: str = "features",
    sample_key: str | None = None,
    out_key: str = "X_agg",
    dims: int | None = None,
    out_type: str = "float",
) -> DataFrame:
    """cell_id and out_key: own features and, per layer and aggregation, those of that ring.

    Layers ascend, whatever the order asked for; layer 0 stands once. A layer is a true shortest
    path distance. Cells without neighbours at a layer get 0. With a sample key edges between samples
    don't count, and cells without a sample have a null vector. dims: length of the features (found if not given).
    out_type: element type of the result.
    """
    need(cells, "cell_id", use_rep, sample_key)
    layers = list(range(n_layers + 1)) if isinstance(n_layers, int) else sorted(set(n_layers))
    names = as_list(aggregations)
    for a in names:
        aggregate(a, F.lit(0.0))
    if dims is None:
        dims = cells.agg(F.max(F.size(use_rep))).first()[0] or 0
    graph = simple_graph(edges, cells, sample_key)
    hops = rings(graph, max(layers)) if max(layers) > 0 else []
    values = cells.select(F.col("cell_id").alias("dst"), F.col(use_rep).cast("array<double>").alias("f"))
    out = cells.select("cell_id", F.col(use_rep).cast("array<double>").alias("own"), (F.col(sample_key).isNotNull() if sample_key else F.lit(True)).alias("has"))
    parts = []
    for layer in layers:
        if layer == 0:
            parts.append(F.col("own"))
            continue
        each = [F.array(*[aggregate(a, F.col("f")[i]) for i in range(dims)]).alias(f"{a}_{layer}") for a in names]
        agg = hops[layer - 1].join(values, "dst").groupBy(F.col("src").alias("cell_id")).agg(*each)
        out = out.join(agg, "cell_id", "left")
        zero = F.array_repeat(F.lit(0.0), dims)
        parts += [F.coalesce(F.col(f"{a}_{layer}"), zero) for a in names]
    return out.select("cell_id", F.when(F.col("has"), F.concat(*parts).cast(f"array<{out_type}>")).alias(out_key))
