"""Lineage cuts for iterative operators, and names of what rows ask."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE, TALL = 2048, 4096  # rows of a key, of either side, that meet in one cell of ``paired``


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder is made only where it is unset and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of ``keys`` into as many parts as the session shuffles into. Spark merges no parts of a given number, so a task
    has its share of the rows however well they compress, and aggregates and joins by these keys (and more) need no other shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str, counts: DataFrame | None = None) -> DataFrame:
    """The columns of ``left``, then ``right``'s others: an inner join on ``keys`` that many rows of both sides have, so that its pairs are most of the work.

    Rows of a key meet in cells of ``WIDE`` rows of the left and ``TALL`` of the right, dealt by their hash, a cell in one task: tasks
    have like shares of the pairs however few keys there are. The right rows of a cell are an array of ``value``, where their other columns
    agree; pairs are formed last and nothing shuffles them. Null keys match nothing. ``counts`` (keys, n): the left rows of each key, if known.
    """
    rest = [c for c in right.columns if c not in (*keys, value)]
    n = F.count(F.lit(1))
    held = right.groupBy(*keys).agg(F.ceil(n / TALL).alias("_tall"))
    counts = left.groupBy(*keys).agg(n.alias("n")) if counts is None else counts
    sizes = cut(counts.select(*keys, F.ceil(F.col("n") / WIDE).alias("_wide")).join(held, keys))
    at = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = right.join(sizes, keys).groupBy(*keys, "_wide", at(right, "_tall").alias("_y"), *rest).agg(F.collect_list(F.struct(value)).alias("_held"))
    cells = cells.select(*keys, *rest, "_y", "_held", every("_wide").alias("_x"))
    rows = left.join(sizes, keys).select(*left.columns, "_tall", at(left, "_wide").alias("_x")).select(*left.columns, "_x", every("_tall").alias("_y"))
    cell = [*keys, "_x", "_y"]
    met = dealt(rows, *cell).join(dealt(cells, *cell), cell)
    return met.select(*left.columns, *rest, F.explode("_held").alias("_one")).select(*left.columns, *rest, F.col(f"_one.{value}").alias(value))


@contextmanager
def bucketed(df: DataFrame, *keys: str, then: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
    """Rows as a Parquet table in the shared folder, in as many buckets of ``keys`` as the session shuffles into: what joins it by these
    keys again and again reads columns, and the table itself is not shuffled. The catalog forgets it at the end of the block. ``then``: what
    is done to the dealt rows before they are written; an aggregate by these keys (and more) needs no shuffle there."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys)
    (rows if then is None else then(rows)).write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def request(columns: list[str]) -> Column:
    """A SHA-256 name of the columns' values: rows with the same name ask the same. Nulls are values of their own."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
