"""Seeded permutations of a label column without sorting or shuffling rows.

For one permutation every cell has a number, a mix of its id and of the permutation's key. In the order
of these numbers the first cells get the first label, as many as it has, the next the second label, and so
on (null last). So a cell's label follows from its number and the numbers at which one label ends: a few
thresholds for each permutation, which are found exactly and broadcast. Any row that names a cell can
tell its label by itself, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The increment and the multipliers of the splitmix64 generator.
STEP, MULTIPLY = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Standard deviations around the expected place of a threshold in which it is looked for.
REACH = 8
#: Counts (permutations times pairs of labels) that a task holds at once.
HELD = 1 << 23


def mix(z: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MULTIPLY[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MULTIPLY[1])
    return z ^ (z >> np.uint64(31))


def perm_keys(n_perms: int, seed: int) -> np.ndarray:
    """The key of each permutation."""
    return mix((np.arange(1, n_perms + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(STEP))


@dataclass(frozen=True)
class Deal:
    """labels in dealing order (null last, if there is any), their counts, and the thresholds of each permutation."""

    labels: list[str | None]
    counts: list[int]
    keys: np.ndarray
    ends: np.ndarray

    def codes(self, cell_ids: np.ndarray, perm: int) -> np.ndarray:
        """The place of the dealt label of every cell in one permutation."""
        return np.searchsorted(self.ends[perm], mix(cell_ids.view(np.uint64) + self.keys[perm]))


def deal(cells: DataFrame, key: str, n_perms: int, seed: int) -> Deal:
    """The permutations of the column key; cells have unique, non-null cell_id.

    The labels are few by nature, and so are the thresholds. Tasks count the numbers below a
    window around the expected place of a threshold, and hand on those inside it: some 16 times the square root
    of the number of cells in all, for each threshold. Should one lie outside, the windows are widened.
    """
    counted = cells.groupBy(F.col(key).cast("string").alias("v")).agg(F.count("*").alias("n")).collect()
    counted.sort(key=lambda r: (r["v"] is None, r["v"] or ""))
    labels, counts = [r["v"] for r in counted], [r["n"] for r in counted]
    n, keys = sum(counts), perm_keys(n_perms, seed)
    upto = np.cumsum(counts)[:-1]
    ids = cells.select(F.col("cell_id").cast("long"))
    reach = REACH
    while True:
        share = upto / max(n, 1)
        half = reach * np.sqrt(share * (1 - share) / max(n, 1)) + 4 / max(n, 1)
        low = np.array([int(max(0.0, x) * 2.0**64) for x in share - half], object)
        high = np.array([min(2**64 - 1, int(min(1.0, x) * 2.0**64)) for x in share + half], object)
        low, high = low.astype(np.uint64), high.astype(np.uint64)

        def run(batches: Iterator[pa.RecordBatch], low: np.ndarray = low, high: np.ndarray = high) -> Iterator[pa.RecordBatch]:
            below, inside = np.zeros((n_perms, len(low)), np.int64), {}
            for b in batches:
                own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for p in range(n_perms):
                    u = mix(own + keys[p])
                    for j in range(len(low)):
                        below[p, j] += np.count_nonzero(u < low[j])
                        found = u[(u >= low[j]) & (u <= high[j])]
                        if len(found):
                            inside.setdefault((p, j), []).append(found)
            at = [(p, j) for p in range(n_perms) for j in range(len(low)) if below[p, j] or (p, j) in inside]
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                packed = [np.concatenate(inside[a]).tobytes() if a in inside else b"" for a in part]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int32()), pa.array([j for _, j in part], pa.int32()), pa.array([int(below[a]) for a in part], pa.int64()), pa.array(packed, pa.binary())], names=["perm", "j", "below", "packed"])

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            j = int(pdf["j"].iloc[0])
            u, place = np.frombuffer(b"".join(pdf["packed"]), np.uint64), int(upto[j]) - int(pdf["below"].sum()) - 1
            end = int(np.partition(u, place)[place].view(np.int64)) if 0 <= place < len(u) else None
            return pd.DataFrame({"perm": [int(pdf["perm"].iloc[0])], "j": [j], "end": pd.array([end], "Int64")})

        ends = np.zeros((n_perms, len(upto)), np.uint64)
        rows = ids.mapInArrow(run, "perm int, j int, below long, packed binary").groupBy("perm", "j").applyInPandas(pick, "perm int, j int, end long").collect() if len(upto) and n_perms else []
        if all(r["end"] is not None for r in rows):
            for r in rows:
                ends[r["perm"], r["j"]] = r["end"] & (2**64 - 1)
            return Deal(labels, counts, keys, ends)
        reach *= 2


def dealt_sums(rows: DataFrame, dealt: Deal, columns: list[str], fixed: str | None = None, weight: str | None = None) -> DataFrame:
    """perm, one label for each of columns (cell ids), fixed (a string column, if named), w: sums of weight (default 1) after dealing.

    Each task adds up all of its rows for every permutation, so that only sums are shuffled; very
    many permutations are done in blocks of HELD sums. fixed has few values by nature.
    """
    n_perms, k = len(dealt.keys), max(1, len(dealt.labels))
    values = [r[0] for r in rows.select(fixed).distinct().collect()] if fixed else [None]
    shared = rows.sparkSession.sparkContext.broadcast((dealt, values))
    size = k ** len(columns) * len(values)
    names = [f"l{i}" for i in range(len(columns))]
    kinds = "perm long, " + ", ".join(f"{x} string" for x in names) + ", fixed string, w double"
    used = rows.select(*[F.col(c).cast("long") for c in columns], (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *([fixed] if fixed else []))

    def block(first: int, last: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealt, values = shared.value
            total, number = np.zeros((last - first, size)), {v: i for i, v in enumerate(values)}
            for b in batches:
                ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
                w = b.column(len(columns)).to_numpy(zero_copy_only=False)
                base = np.array([number[v] for v in b.column(len(columns) + 1).to_pylist()], np.int64) if fixed else 0
                for p in range(first, last):
                    cell = base
                    for x in ids:
                        cell = cell * k + dealt.codes(x, p)
                    total[p - first] += np.bincount(cell, weights=w, minlength=size)
            perm, cell = np.nonzero(total)
            for i in range(0, len(perm), 1 << 16):
                p, c = perm[i : i + (1 << 16)], cell[i : i + (1 << 16)]
                out, rest = [], c
                for _ in columns:
                    out.insert(0, pa.array([dealt.labels[x] for x in (rest % k).tolist()], pa.string()))
                    rest = rest // k
                out.append(pa.array([values[x] for x in rest.tolist()], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(p + first, pa.int64()), *out, pa.array(total[p, c])], names=["perm", *names, "fixed", "w"])

        return used.mapInArrow(run, kinds)

    step = max(1, HELD // max(1, size))
    parts = [block(i, min(n_perms, i + step)) for i in range(0, n_perms, step)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    summed = out.groupBy("perm", *names, "fixed").agg(F.sum("w").alias("w"))
    return summed.select("perm", *names, *([F.col("fixed").alias(fixed)] if fixed else []), "w")
