"""What operators need from a running session: a shared folder, cutting lineage there, names, and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows (and more than LEAST of them) is hot.
HOT_SHARE, LEAST = 1000, 1000
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary one is set under a local master; elsewhere that is an
    error, as each machine would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="nichespark-"))
    return named or context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; cleanup() deletes it."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cleanup(spark: SparkSession) -> None:
    """Delete all that new_path named in this session: tables, archives, token files.

    For when results have been read: DataFrames that read those paths are of no use afterwards.
    Checkpoints go with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(taken: Iterable[str], name: str) -> str:
    """name, with underscores added until no taken name equals it; Spark ignores case, and so does this."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """Like settle, but as a compressed Parquet table in the shared folder; for wide rows."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with the table's other columns; rows of hot keys are not gathered in one task.

    table: key (unique), n (how many rows have the key), and one column or more; settled. There
    are at most HOT_SHARE hot keys, as their rows add up: they are looked up first, and broadcast
    if there are any. The other rows are joined by key. Rows without a partner go.
    """
    limit = max(n_rows // HOT_SHARE, LEAST)
    hot = table.where(F.col("n") > limit).drop("n")
    if n_rows <= limit or hot.isEmpty():
        return rows.join(table.drop("n"), key)
    few = hot.select(F.col(key).alias("hot_key"))
    known = F.broadcast(hot)
    return rows.join(known, key).unionByName(rows.join(F.broadcast(few), F.col(key) == F.col("hot_key"), "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key))
