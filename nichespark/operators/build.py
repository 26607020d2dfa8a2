"""Spatial graphs: lattice, radius, k nearest neighbours, Delaunay. Edges come in both directions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.functions.checks import need
from nichespark.runtime import settle


def lattice_edges(cells: DataFrame, gx: str = "gx", gy: str = "gy", sample: str | None = None, diagonal: bool = False) -> DataFrame:
    """src, dst, weight, dist of neighbouring lattice places (4, or 8 with diagonal): one equi-join."""
    need(cells, "cell_id", gx, gy, sample)
    own = [F.col(sample).alias("s")] if sample else [F.lit(0).alias("s")]
    a = cells.select(F.col("cell_id").alias("src"), F.col(gx).alias("ax"), F.col(gy).alias("ay"), *own)
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    near = F.explode(F.array(*[F.struct((F.col("ax") + dx).alias("x"), (F.col("ay") + dy).alias("y"), F.lit(math.hypot(dx, dy)).alias("d")) for dx, dy in steps]))
    a = a.select("src", "s", near.alias("n")).select("src", "s", "n.x", "n.y", "n.d")
    b = cells.select(F.col("cell_id").alias("dst"), F.col(gx).alias("x"), F.col(gy).alias("y"), *own)
    return a.join(b, ["x", "y", "s"]).select("src", "dst", F.lit(1.0).alias("weight"), F.col("d").alias("dist"))


def _near_pairs(asking: DataFrame, cells: DataFrame, h: float) -> DataFrame:
    """src, dst, dist for all pairs of one sample whose grid squares of width h touch."""
    bin_of = lambda c: F.floor(F.col(c) / h)
    a = asking.select(F.col("cell_id").alias("src"), F.col("s"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.withColumn("o", shift).withColumns({"bx": bin_of("ax") + F.col("o.i"), "by": bin_of("ay") + F.col("o.j")}).drop("o")
    b = cells.select(F.col("cell_id").alias("dst"), "s", F.col("x").alias("tx"), F.col("y").alias("ty"), bin_of("x").alias("bx"), bin_of("y").alias("by"))
    d = F.sqrt((F.col("ax") - F.col("tx")) * (F.col("ax") - F.col("tx")) + (F.col("ay") - F.col("ty")) * (F.col("ay") - F.col("ty")))
    return a.join(b, ["s", "bx", "by"]).where("src <> dst").select("src", "dst", d.alias("dist"))


def _places(cells: DataFrame, sample: str | None) -> DataFrame:
    need(cells, "cell_id", "x", "y", sample)
    return cells.select("cell_id", F.col("x").cast("double"), F.col("y").cast("double"), (F.col(sample) if sample else F.lit("")).cast("string").alias("s")).where("x is not null and y is not null and s is not null")


def radius_edges(cells: DataFrame, radius: float, sample: str | None = None) -> DataFrame:
    """All pairs at most radius apart, by an equi-join on grid squares."""
    pairs = _near_pairs(p := _places(cells, sample), p, radius)
    return pairs.where(F.col("dist") <= radius).select("src", "dst", F.lit(1.0).alias("weight"), "dist")


def _crowd(places: DataFrame, h: float) -> float:
    """How many cells the square of a cell has on average."""
    counts = places.groupBy("s", F.floor(F.col("x") / h), F.floor(F.col("y") / h)).agg(F.count("*").cast("double").alias("n"))
    return counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]


def knn_edges(cells: DataFrame, k: int = 6, sample: str | None = None, symmetric: bool = True, start: float | None = None) -> DataFrame:
    """The k nearest of every cell (ties to the smaller id), both directions if symmetric.

    Cells look for neighbours in the 3 by 3 grid squares around them. Who has k within one
    square's width is done; the others go on with squares of double width, until the grid
    covers everything. So no cross join is made, and the result is exact. The first width comes from the
    counts: it is made smaller until the square of a cell has few others on average, so that cells far
    off make no crowded squares elsewhere.
    """
    places = settle(_places(cells, sample))
    box = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not box[4]:
        return places.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("dist"))
    extent = max(box[1] - box[0], box[3] - box[2], 1e-12)
    h = start or extent * math.sqrt(2 * k / box[4])
    while not start and h > extent * 2.0**-40 and _crowd(places, h) > 16 * k:
        h /= 4
    left, found = places, None
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    while True:
        whole = h > extent
        near = _near_pairs(left, places, h)
        top = settle(near.withColumn("r", rank).where(F.col("r") <= k))
        if whole:
            part = top
        else:
            done = top.groupBy("src").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where((F.col("n") == k) & (F.col("far") < h)).select("src")
            part = top.join(done, "src", "left_semi")
            left = settle(left.join(done, left["cell_id"] == done["src"], "left_anti"))
        found = part if found is None else found.unionByName(part)
        if whole or left.isEmpty():
            break
        h *= 2
    one = found.select("src", "dst", "dist")
    if symmetric:
        one = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    return one.select("src", "dst", F.lit(1.0).alias("weight"), "dist")


def delaunay_edges(cells: DataFrame, sample: str | None = None) -> DataFrame:
    """Delaunay edges within each sample; a sample is one task, as a tissue section fits in memory."""
    from nichespark.operators.geometry import delaunay

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pts = pdf[["x", "y"]].to_numpy(float)
        t = delaunay(pts)
        e = np.unique(np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0) if len(t) else np.zeros((0, 2), int)
        both = np.concatenate([e, e[:, ::-1]])
        ids = pdf["cell_id"].to_numpy()
        return pd.DataFrame({"src": ids[both[:, 0]], "dst": ids[both[:, 1]], "weight": 1.0, "dist": np.hypot(*(pts[both[:, 0]] - pts[both[:, 1]]).T)})

    return _places(cells, sample).groupBy("s").applyInPandas(run, "src long, dst long, weight double, dist double")
