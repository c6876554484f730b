"""Small helpers shared by the operators: table access, lineage cuts and fixed partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by Spark's own reader, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder is made only where that is unset and Spark runs locally."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow intermediate with checkpoint(), which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise a larger intermediate as a compressed Parquet table in the shared folder, beside the checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batched(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by rows and bytes, so that tasks over long texts keep little in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_text(col: str) -> Column:
    """An id as text for hashing; null becomes an own value, so that it groups with itself only."""
    return F.coalesce(F.col(col).cast("string"), F.lit("\x00null"))


def crc_fold(col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n: the fold rule of the held-out contracts."""
    return F.pmod(F.crc32(key_text(col).cast("binary")), F.lit(n))


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A narrow, already cut table: with a broadcast hint if it has ``max_rows`` rows at most, else for a shuffled join.

    Spark splits the hot partitions of the shuffled form (adaptive skew join). Only for tables of a few numbers a row.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


SLICES = 1000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int, spread: list[str], how: str = "inner", slices: int = SLICES) -> DataFrame:
    """left join right on ``keys``, with the rows of hot keys dealt over several tasks.

    ``counts`` (keys, _n) has the left rows of each key and ``total`` their sum. A key with more than total / slices rows is
    hot, so there are at most ``slices`` such keys and their list may be broadcast; each is dealt by a hash of ``spread``
    into pieces of about total / slices rows, and the right rows of the key go to all of its pieces.
    """
    limit = max(total / slices, 1)
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))
    one = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), one)).drop("_salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), one.cast("long") - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``_row`` beside the given ones, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(name) for name, c in columns.items()])


def text_key(text_col: str) -> dict[str, Column]:
    """A text's 128-bit name as two longs; null and the empty text have the same."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("second"), text)}
