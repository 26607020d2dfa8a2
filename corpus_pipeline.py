"""A corpus pipeline of five stages: quality, language, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each
stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichespark.llm.bpe import encode
from nichespark.llm.langid import fit, predict
from nichespark.llm.mixing import mix
from nichespark.llm.nearcopies import drop_near_copies
from nichespark.llm.quality import judge
from nichespark.runtime import fresh_name, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A verdict depends on text, language and source only, so rows and verdicts meet by doc_id and a
    hash of these; no copy of the texts is stored. A text of under 50 words, which op4's contract
    fails, stays if it has a word and doesn't repeat itself: rates say little about it, and clean texts are among them.
    """
    key = fresh_name(docs.columns, "stage_row")
    hashed = docs.withColumn(key, F.xxhash64("text", "lang", "source"))
    kept = judge(hashed, keep=(key,), min_words=1).where("kept").select(F.col("doc_id").alias("kept_id"), F.col(key).alias("kept_key")).distinct()
    return hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["kept_id"]) & (hashed[key] == kept["kept_key"]), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: A document whose winning language has less than so many times an even share of the score is in none that the model knows.
CLEAR = 1.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; `lang` becomes that language.

    The model is trained on labels of this stage's own input. Documents without a letter go, as do
    those that all languages parse about equally badly.
    """
    model = fit(docs)
    even = CLEAR / len(model.languages) if len(model.languages) > 1 else 0.0
    name = fresh_name(docs.columns, "stage_row")
    found = predict(docs, model, names=(name, f"{name}_score")).where((F.col(name) != "und") & (F.col(f"{name}_score") >= even))
    return found.withColumn("lang", F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Shingles of five words and a Jaccard similarity of 0.8 or more, found by ball hashing of several
    SimHashes; the settings of op2 (four words, 4 bits of one SimHash) are those of its contract.
    """
    return drop_near_copies(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix."""
    ids = encode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: Language ID and the exact similarity of shingles are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
