"""Exact order statistics and global ranks without gathering rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.runtime import settle

#: Rows that the last step of exact_percentile may bring to the driver.
FEW = 100_000


def exact_percentile(df: DataFrame, column: str, q: float) -> float | None:
    """The linearly interpolated q-quantile (0 to 1) of a double column; nulls and NaN are ignored.

    Counts narrow a bracket of values down until it holds few rows; these are sorted. Nothing
    grows with the number of rows but the passes' partial counts.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    row = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    n, low, high = row
    if not n:
        return None
    place = q * (n - 1)
    first, last = math.floor(place), math.ceil(place)

    def at(rank: int) -> float:
        a, b, below, inside = low, high, 0, n
        while inside > FEW and a < b:
            width = (b - a) / 1024
            if not width > 0 or a + width == a:
                break
            cell = F.least(F.floor((F.col("v") - a) / width), F.lit(1023))
            counts = sorted((r[0], r[1], r[2], r[3]) for r in values.where(F.col("v").between(a, b)).groupBy(cell.alias("c")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
            for _, k, lo, hi in counts:
                if below + k > rank:
                    if (lo, hi) == (a, b):
                        inside = 0
                    else:
                        a, b, inside = lo, hi, k
                    break
                below += k
            if not inside:
                break
        found = values.where(F.col("v").between(a, b)).groupBy("v").count().orderBy("v")
        for v, k in found.toLocalIterator():
            if below + k > rank:
                return v
            below += k
        return b

    x = at(first)
    y = x if last == first else at(last)
    return x + (y - x) * (place - first)


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with its rank (from 0) in a total order: range partitions, ranks within, counts ahead."""
    parted = settle(df.repartitionByRange(*order).withColumn("rank_part", F.spark_partition_id()))
    sizes = dict(parted.groupBy("rank_part").count().collect())
    ahead, sums = 0, {}
    for p in sorted(sizes):
        sums[p] = ahead
        ahead += sizes[p]
    if not sums:
        return parted.withColumn(name, F.lit(0).cast("long")).drop("rank_part")
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in sums.items() for x in kv]), F.col("rank_part").cast("long"))
    own = F.row_number().over(Window.partitionBy("rank_part").orderBy(*order)).cast("long") - 1
    return parted.withColumn(name, start + own).drop("rank_part")
