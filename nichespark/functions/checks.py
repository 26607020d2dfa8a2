"""Validation of keys while a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame


def need(df: DataFrame, *columns: str) -> None:
    """Raise KeyError for a column that df hasn't."""
    for c in columns:
        if c is not None and c not in df.columns:
            raise KeyError(f"no column {c!r}; there are {df.columns}")


def as_list(value) -> list | None:
    """A scalar string as a list of one; lists and None as they are."""
    return [value] if isinstance(value, str) else value


def with_params(result: DataFrame, column: str = "enrichment", **params) -> DataFrame:
    """The result with the parameters that made it in the metadata of a column, where they stay when it is written."""
    return result.withMetadata(column, {"params": {k: v for k, v in params.items() if v is not None}})


def params_of(result: DataFrame, column: str = "enrichment") -> dict:
    """The parameters that a result was made with."""
    return dict(result.schema[column].metadata.get("params", {}))
