"""Aggregations by name, for neighbourhood features; users may register their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "var": F.var_pop}


def register_aggregate(name: str, make: Callable[[Column], Column]) -> None:
    """Let aggregate_neighbors use make(value) under this name."""
    AGGREGATES[name] = make


def aggregate(name: str, value: Column) -> Column:
    if name not in AGGREGATES:
        raise NotImplementedError(f"no aggregation named {name!r}; known: {sorted(AGGREGATES)}")
    return AGGREGATES[name](value)


def log_ratio(observed: Column, expected: Column, log: bool = True) -> Column:
    """log2(observed / expected), -Infinity at 0, or the ratio itself; null where expected is 0."""
    ratio = F.try_divide(observed, expected)
    return F.when(ratio > 0, F.log2(ratio)).when(ratio == 0, F.lit(float("-inf"))) if log else ratio
