"""Ordinals, review queues and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordinal(rows: DataFrame, key: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """Position of each row inside its key, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def top_per_key(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each task's groups before the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def stratified(rows: DataFrame, strata: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum in the order of a seeded digest: the same rows on every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return top_per_key(rows.withColumn("_digest", digest), [strata], ["_digest", key], k).drop("_digest")


def review_queue(rows: DataFrame, levels: dict[str, list[str]], then: list, k: int = 300) -> DataFrame:
    """The first k rows by listed enum columns (values not listed, and null, last), then by ``then``.

    Spark keeps k rows a task and merges them (TakeOrderedAndProject): no full sort.
    """
    order = [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)), F.lit(0)), F.lit(len(values) + 1)) for c, values in levels.items()]
    return rows.orderBy(*order, *then).limit(k)
