"""Component polygons and their shape metrics."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.operators import geometry as g

RINGS = "array<array<struct<x: double, y: double>>>"


def _plain(rings) -> list[g.Ring]:
    return [[(p["x"], p["y"]) for p in ring] for ring in rings]


def boundaries(cells: DataFrame, cluster_key: str = "component", min_hole_area_ratio: float = 0.1, alpha_start: float = 2000) -> DataFrame:
    """component, rings: the alpha shape of each component's cells (null and "-1" left out).

    A component is a task, as its triangulation needs its cells together; only places travel.
    """
    need(cells, cluster_key, "x", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = g.component_rings(pdf[["x", "y"]].to_numpy(float), min_hole_area_ratio, alpha_start)
        if rings is None:
            return pd.DataFrame({"component": [], "rings": []})
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "rings": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]})

    used = cells.select(F.col(cluster_key).cast("string").alias("component"), F.col("x").cast("double"), F.col("y").cast("double")).where("component is not null and component <> '-1' and x is not null and y is not null")
    return used.groupBy("component").applyInPandas(run, f"component string, rings {RINGS}")


def _metric(name: str, compute: Callable[[list[g.Ring]], float]) -> Callable[[DataFrame], DataFrame]:
    def of(polygons: DataFrame) -> DataFrame:
        value = F.pandas_udf(lambda s: pd.Series([compute(_plain(r)) for r in s], dtype=float), "double")
        return polygons.where(F.col("rings").isNotNull()).select("component", F.lit(name).alias("metric"), value("rings").alias("value"))

    return of


def linearity_metric(polygons: DataFrame, height: int = 1000, min_ratio: float = 0.05) -> DataFrame:
    """component, metric, value: longest path or cycle of the skeleton over its length."""
    return _metric("linearity", lambda r: g.linearity(r, height, min_ratio))(polygons)


def elongation_metric(polygons: DataFrame) -> DataFrame:
    """component, metric, value: 1 - minor / major side of the smallest rectangle around it."""
    return _metric("elongation", g.elongation)(polygons)


def curl_metric(polygons: DataFrame) -> DataFrame:
    """component, metric, value: how much longer the fibre is than the rectangle."""
    return _metric("curl", g.curl)(polygons)


def ring_table(polygons: DataFrame) -> DataFrame:
    """component, ring, seq, x1, y1, x2, y2: the sides of all rings."""
    flat = polygons.select("component", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 0)
    side = flat.select("component", "ring", F.col("points"), F.posexplode("points").alias("seq", "p"))
    after = F.get(F.col("points"), (F.col("seq") + 1) % F.size("points"))
    return side.select("component", "ring", "seq", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"))


def area_perimeter(polygons: DataFrame) -> DataFrame:
    """component, area (holes taken off), perimeter (of all rings): sums over sides."""
    sides = ring_table(polygons)
    per = sides.groupBy("component", "ring").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"), F.sum(F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))).alias("l"))
    return per.groupBy("component").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"), F.sum("l").alias("perimeter"))


def cells_inside(cells: DataFrame, polygons: DataFrame, library: DataFrame | None = None, exterior: bool = False, strips: int | None = None) -> DataFrame:
    """component, cell_id of cells inside polygons (crossing parity).

    The sides of polygons and the cells meet by strips of y: an equi-join on the strip (and the library), then
    crossings are counted to the right of each cell. library: component, library.
    """
    sides = ring_table(polygons)
    if exterior:
        sides = sides.where("ring = 0")
    box = polygons.select(F.explode("rings").alias("r")).select(F.explode("r").alias("p")).agg(F.min("p.y"), F.max("p.y"), F.count("*")).first()
    if box[0] is None:
        return cells.sparkSession.createDataFrame([], "component string, cell_id long")
    # a polygon of n sides has about as many strips as sides: few sides to a strip, and few strips to a side
    h = max((box[1] - box[0]) / (strips or min(1 << 16, max(32, box[2] // 4))), 1e-9)
    strip = lambda c: F.floor((c - F.lit(box[0])) / h)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    sides = sides.where("y1 <> y2").withColumn("strip", F.explode(F.sequence(strip(low), strip(high))))
    points = cells.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(["library"] if library is not None else [])).where(F.col("y").between(box[0], box[1])).withColumn("strip", strip(F.col("y")))
    keys = ["strip"]
    if library is not None:
        sides, keys = sides.join(library, "component"), ["strip", "library"]
    hit = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    return points.join(sides, keys).where(hit).groupBy("component", "cell_id").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("component", "cell_id")


def purity_metric(cells: DataFrame, polygons: DataFrame, cluster_key: str = "component", library_key: str | None = "sample", exterior: bool = False) -> DataFrame:
    """component, metric, value: the component's cells inside its polygon over all cells of its library inside it.

    A component belongs to the library of its first cell. Holes are left out unless exterior.
    """
    need(cells, "cell_id", "x", "y", cluster_key, library_key)
    own = cells.select("cell_id", "x", "y", F.col(cluster_key).cast("string").alias("own"), (F.col(library_key).cast("string") if library_key else F.lit("")).alias("library"))
    library = own.where("own is not null").groupBy(F.col("own").alias("component")).agg(F.min_by("library", "cell_id").alias("library"))
    found = cells_inside(own, polygons, library, exterior).join(own.select("cell_id", "own"), "cell_id")
    same = F.sum(F.coalesce(F.col("own") == F.col("component"), F.lit(False)).cast("long"))
    return found.groupBy("component").agg((same.cast("double") / F.count("*")).alias("value")).select("component", F.lit("purity").alias("metric"), "value")


def relative_component_size_metric(cells: DataFrame, neighborhood_key: str, cluster_key: str = "component", library_key: str | None = None) -> DataFrame:
    """component, neighborhood (and library), value: cells of a component over the mean number per component there.

    A component that lies in two neighbourhoods has a row for each. Cells without a component
    count for the neighbourhood, but make no component.
    """
    need(cells, neighborhood_key, cluster_key, library_key)
    by = [F.col(neighborhood_key).cast("string").alias("neighborhood"), *([F.col(library_key).cast("string").alias("library")] if library_key else [])]
    keys = ["neighborhood", *(["library"] if library_key else [])]
    base = cells.select(F.col(cluster_key).cast("string").alias("component"), *by).where(" and ".join(f"{k} is not null" for k in keys))
    counts = base.groupBy("component", *keys).agg(F.count("*").alias("n"))
    size = counts.where("component is not null").groupBy("component").agg(F.sum("n").alias("size"))
    per = counts.groupBy(*keys).agg(F.sum("n").alias("cells"), F.count("component").alias("components"))
    rows = counts.where("component is not null").select("component", *keys).join(size, "component").join(per, keys)
    return rows.select("component", *keys, (F.col("size") / (F.col("cells").cast("double") / F.col("components"))).alias("value"))


def _deprecated(name: str, new: Callable) -> Callable:
    def call(*args, **kwargs):
        warnings.warn(f"{name} is deprecated, use {new.__name__}", FutureWarning, stacklevel=2)
        return new(*args, **kwargs)

    call.__name__, call.__doc__ = name, f"Deprecated name of {new.__name__}."
    return call


linearity = _deprecated("linearity", linearity_metric)
elongation = _deprecated("elongation", elongation_metric)
curl = _deprecated("curl", curl_metric)
purity = _deprecated("purity", purity_metric)


def with_wkb(polygons: DataFrame) -> DataFrame:
    """component, wkb: polygons as well-known binary, for Parquet."""
    pack = F.pandas_udf(lambda s: pd.Series([g.to_wkb(_plain(r)) for r in s]), "binary")
    return polygons.select("component", pack("rings").alias("wkb"))


def from_wkb(rows: DataFrame) -> DataFrame:
    """component, rings from component, wkb."""

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"component": pdf["component"], "rings": [[[{"x": x, "y": y} for x, y in r] for r in g.from_wkb(w)] for w in pdf["wkb"]]})

    return rows.select("component", "wkb").mapInPandas(run, f"component string, rings {RINGS}")
