"""Sharding by sampled splitters (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.llm.prefix import _constant, range_order
from nichespark.runtime import settle

LOWEST = -(1 << 63)


def assign_shards(records: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, whole_group_share: float = 0.02) -> DataFrame:
    """Deal records into n_shards of nearly equal bytes; equal texts stay together where they can.

    Records are ordered by (crc32 of the text, id). Splitters are quantiles of a sample drawn in
    proportion to size; records are range-partitioned by them, overfull ranges are subdivided, and
    prefix sums over the ranges give every record its exact byte offset in the order. Shard s takes
    the offsets from s/n to (s+1)/n of all bytes. Records with equal text are moved as one if
    together they are at most whole_group_share of a shard; larger groups are divided. (Texts that share
    a CRC count as equal for that.)

    Result: id_col, size (UTF-8 bytes plus overhead; null text counts no bytes), text_crc32
    (unsigned; a null text has that of the empty one, 0), shard, slot (position in the shard, from
    0, without gaps). Null ids sort first; repeated rows each get a slot of their own; other
    columns of the input are ignored; an empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = settle(
        records.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("crc"),
        ).withColumns({"order_id": F.coalesce(F.col("id").cast("long"), F.lit(LOWEST)), "uid": F.monotonically_increasing_id()})
    )
    order = range_order(narrow, ["crc", "order_id", "uid"], "size", min_ranges=max(192, 16 * n_shards), keep_groups=True)
    group = Window.partitionBy("range_id", "crc")
    share = max(1, order.weight)
    # ranges cut none but hot groups, which are far above the share
    whole = (F.sum("size").over(group) <= whole_group_share * share / n_shards) & ~F.array_contains(_constant(list(order.hot), "array<bigint>"), F.col("crc"))
    start = F.when(whole, F.min("before").over(group)).otherwise(F.col("before"))
    placed = order.rows.withColumn("start", start).withColumn("shard", F.least(F.expr(f"start * {n_shards} div {share}"), F.lit(n_shards - 1)).cast("int"))
    placed = settle(placed.select("id", "size", "crc", "shard", "rank"))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    firsts = _constant([first.get(s, 0) for s in range(n_shards)], "array<bigint>")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.get(firsts, F.col("shard"))).alias("slot"))


def write_shards(records: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write records as Parquet, a folder for each shard. Ids must be unique and not null."""
    where = assign_shards(records, n_shards, id_col, text_col).select(id_col, "shard", "slot")
    rest = records.drop("shard", "slot")
    rest.join(where, id_col).repartition("shard", F.pmod(F.col("slot"), F.lit(16))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
