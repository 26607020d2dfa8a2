"""The streaming form gives the batch's counts."""

from pyspark.sql import functions as F

from nichespark.streaming.shares import windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), (F.col("id") % 3).cast("string").alias("cluster"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream, "cluster").writeStream.outputMode("complete").format("memory").queryName("shares").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM shares").collect()}
    assert got == {tuple(r) for r in windowed_counts(rows, "cluster").collect()} and sum(r[2] for r in got) == 300
