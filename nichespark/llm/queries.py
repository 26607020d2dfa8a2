"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.sharding import assign_shards

    placed = assign_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.bpe import decode, encode

    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = decode(ids.drop("text"), keep_ids=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.langid import fit, predict

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.warc import capture_history, read_archives, write_archives

    # made-up times, of the same century for any page_id
    pages = _table(spark, sf_dir, "pages").withColumn("fetched", F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)) + F.lit(1_000_000_000)))
    archives = write_archives(pages)
    history = capture_history(read_archives(spark, archives))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.tokenfile import read_token_files, write_token_files

    files = write_token_files(_table(spark, sf_dir, "documents"))
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nichespark.llm.tokencount import count_tokens

    counted = count_tokens(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_simhash, op3_mixing, op4_quality, op5_bpe, op6_topk, op7_langid, op8_warc, op9_token_file, op10_token_counts, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from nichespark.llm.oracles import ORACLES

    return dict(ORACLES)
