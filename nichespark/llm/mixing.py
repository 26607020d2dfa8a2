"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.llm.prefix import range_order
from nichespark.runtime import fresh_name, settle, settle_table

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources come to the driver as one row each; more than this is an error, not a cut.
MAX_SOURCES = 1_000_000
LOWEST = -(1 << 63)


def share_out(sizes: list[int], weights: list[int], budget: Fraction, most: int) -> list[Fraction]:
    """Split budget by weight; a share stops at most * size and its excess is shared again."""
    targets = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), budget
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in full or free:
            targets[i] = Fraction(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        free -= full
    return targets


def offset(seed: int) -> float:
    """The random offset of the systematic sample, a multiple of 2**-20."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, most: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document.

    Size: the words of the text (null: none). Sources in order of code points, null last, take the
    weights in turn and share budget_percent of all sizes; a target stops at `most` times its
    source's size and the excess is shared again. Each document of a source is expected
    target / source_size times. Within its source, ordered by (size, id), the expected copies are
    summed ahead of it, one random offset (of the seed) is added, and it is taken once for each
    integer crossed. The order by size makes the words taken follow the target closely; the ranks come from
    range_order, so a hot source is no hot task.

    Result: id_col, keep columns, size, source_size, target (rounded to 6 decimals), copies, taken
    (copies * size). A source of size 0 has target 0 and is never taken. Null ids sort first,
    repeated rows are separate documents, no rows give no rows, other columns are ignored.
    """
    narrow = settle(
        docs.select(
            F.col(id_col).alias("mix_id"),
            F.col(source_col).cast("string").alias("mix_source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("mix_size"),
            *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        )
    )
    found = narrow.groupBy("mix_source").agg(F.count("*").alias("n"), F.sum("mix_size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["mix_source"] is None, r["mix_source"] or ""))
    sizes = [r["s"] for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], Fraction(sum(sizes) * budget_percent, 100), most)
    rows, first = [], 0
    for i, (r, t) in enumerate(zip(found, targets, strict=True)):
        rows.append((r["mix_source"], i, first, r["s"], round(float(t), 6)))
        first += r["n"]
    sources = docs.sparkSession.createDataFrame(rows, "of string, ord long, first long, source_size long, target double")
    narrow = narrow.join(sources, F.col("mix_source").eqNullSafe(F.col("of")), "inner").withColumns({"one": F.lit(1).cast("long"), "order_id": F.coalesce(F.col("mix_id").cast("long"), F.lit(LOWEST)), "uid": F.monotonically_increasing_id()})
    order = range_order(settle(narrow.drop("of", "mix_source")), ["ord", "mix_size", "order_id", "uid"], "one", min_ranges=96)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(F.lit(0.0))
    place = (F.col("rank") - F.col("first")).cast("double")
    u = offset(seed)
    copies = (F.floor((place + 1.0) * rate + u) - F.floor(place * rate + u)).cast("long")
    return order.rows.withColumn("copies", copies).select(F.col("mix_id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as mix_counts takes it, with the input's columns.

    The documents are written once to the shared folder with a row id, so that counts and texts
    meet by that id, and repeated or null doc_ids are no trouble.
    """
    row, copies = fresh_name(docs.columns, "mix_row"), fresh_name(docs.columns, "mix_copies")
    stored = settle_table(docs.withColumn(row, F.monotonically_increasing_id()))
    counted = mix_counts(stored, keep=(row,), **options).where("copies > 0").select(row, F.col("copies").cast("int").alias(copies))
    return stored.join(counted, row).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(row)).drop(row)
