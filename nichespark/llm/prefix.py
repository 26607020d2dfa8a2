"""Exact distributed ranks and prefix sums over a global order, by sampled splitters.

Only DataFrame functions touch the rows. The driver sees a sample of bounded size and one row of
counts for each range.
"""

from __future__ import annotations

import bisect
import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Order:
    """rows: the input with range_id, rank (from 0) and before (sum of the weights ahead); totals; first keys that ranges may cut."""

    rows: DataFrame
    n_rows: int
    weight: int
    hot: tuple[int, ...] = ()


def _constant(value: list, kind: str) -> Column:
    """A list as one foldable literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _range_of(keys: list[str], splitters: list[tuple[int, ...]]) -> Column:
    """How many splitters are not above the row's key, found in a search tree of three levels."""
    if not splitters:
        return F.lit(0).cast("int")
    width = 2
    while width**3 < len(splitters) + 1:
        width += 1
    # leaf i covers the splitters i*width .. ; an upper level holds the first splitter of each node below but the first
    names = [f"k{i}" for i in range(len(keys))]
    cell = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    padded = [dict(zip(names, s, strict=True)) for s in splitters]
    below, middle, upper = [], [], []
    for i in range(0, len(padded) + 1, width * width):
        if i:
            upper.append(padded[i - 1])
        part_mid, part_low = [], []
        for j in range(i, min(i + width * width, len(padded) + 1), width):
            if j > i:
                part_mid.append(padded[j - 1])
            part_low.append(padded[j : min(j + width - 1, len(padded))])
        middle.append(part_mid)
        below.append(part_low)
    key = F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])

    def count(tree: Column) -> Column:
        return F.size(F.filter(tree, lambda s: s <= key))

    top = count(_constant(upper, f"array<{cell}>"))
    # bind each level's result once, by a lambda over an array of one
    return F.transform(
        F.array(top),
        lambda a: F.transform(
            F.array(count(F.get(_constant(middle, f"array<array<{cell}>>"), a))),
            lambda b: (a * (width * width) + b * width + count(F.get(F.get(_constant(below, f"array<array<array<{cell}>>>"), a), b))).cast("int"),
        )[0],
    )[0]


def range_order(df: DataFrame, keys: list[str], weight: str, min_ranges: int = 192, rows_per_range: int = 200_000, max_ranges: int = 4096, draws: int = 16, seed: int = 7, keep_groups: bool = False) -> Order:
    """Rank rows by keys (long, no nulls) and sum weight (long, positive) ahead of each, exactly.

    Each row enters the sample with a chance in proportion to its weight (decided by a hash of its
    key, so that reruns and retried tasks agree); about `draws` samples stand for each range.
    Every draws-th sample is a splitter. Ranges that turn out to hold over twice their share of
    rows or weight are subdivided at the samples inside them, at every second of those left each time, until none
    is overfull or no sample is left in it. At most max_ranges * draws samples
    come to the driver (65,536 by default), whatever the input. With keep_groups a splitter is
    moved ahead of all rows with the same first key, unless that key has twice the sample of a range or more:
    only such hot groups are cut. df is read several times: cut its lineage
    first. An empty df gives no rows and totals 0.
    """
    total = df.agg(F.count("*"), F.sum(weight)).first()
    n, w = int(total[0]), int(total[1] or 0)
    if not n:
        return Order(df.withColumns({"range_id": F.lit(0), "rank": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}), 0, 0)
    ranges = max(min_ranges, min(max_ranges, n // rows_per_range + 1))
    chance = F.col(weight).cast("double") * (ranges * draws / w)
    hashed = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = sorted(tuple(r) for r in df.where(hashed < chance).select(*keys).collect())

    drawn = Counter(x[0] for x in sample)
    hot = {k for k, c in drawn.items() if c >= 2 * draws} if keep_groups else set()
    low = tuple([LOWEST] * (len(keys) - 1))

    def cut(at: set[int]) -> list[tuple[int, ...]]:
        picked = {sample[i] for i in at}
        if not keep_groups:
            return sorted(picked)
        return sorted({x if x[0] in hot else (x[0], *low) for x in picked} | {(x[0], *low) for x in picked})

    def held(splitters: list[tuple[int, ...]]) -> dict[int, tuple[int, int]]:
        rows = df.groupBy(_range_of(keys, splitters).alias("r")).agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()
        return {r["r"]: (r["n"], r["w"]) for r in rows}

    at, step = set(range(draws, len(sample), draws)), draws
    splitters = cut(at)
    sizes = held(splitters)
    while step > 1 and (over := {r for r, (a, b) in sizes.items() if a > 2 * n / ranges or b > 2 * w / ranges}):
        step //= 2
        at |= {i for i in range(0, len(sample), step) if bisect.bisect_right(splitters, sample[i]) in over}
        finer = cut(at)
        if finer != splitters:
            splitters, sizes = finer, held(finer)
    rows_before, weight_before, a, b = [], [], 0, 0
    for r in range(len(splitters) + 1):
        rows_before.append(a)
        weight_before.append(b)
        a, b = a + sizes.get(r, (0, 0))[0], b + sizes.get(r, (0, 0))[1]
    in_range = Window.partitionBy("range_id").orderBy(*keys)
    rows = (
        df.withColumn("range_id", _range_of(keys, splitters))
        .withColumn("rank", F.row_number().over(in_range).cast("long") - 1 + F.get(_constant(rows_before, "array<bigint>"), F.col("range_id")))
        .withColumn("before", F.sum(weight).over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) + F.get(_constant(weight_before, "array<bigint>"), F.col("range_id")))
    )
    return Order(rows, n, w, tuple(sorted(hot)))
