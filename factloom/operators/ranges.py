"""Ordered work over groups of any size: range partitions, with what earlier partitions carry over.

A window by group puts a whole group into one task. Here rows are range-partitioned by group and order, so a large group lies in
many partitions; each (group, partition) is a window of its own, and the groups' partitions, which are few, are ordered
among themselves to carry totals or last values over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.common import cut

PART = "_part"


def ranged(rows: DataFrame, by: list[str], order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """``rows`` with their range partition; rows that are equal in ``by`` and ``order`` lie in one."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()))


def carried(rows: DataFrame, by: list[str], last: Column, name: str) -> DataFrame:
    """(by, part, name): the latest non-null ``last`` (an aggregate) of the group's earlier partitions; ``rows`` as ``ranged`` gives them."""
    per = rows.groupBy(*by, PART).agg(last.alias("_last"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, PART, F.last("_last", ignorenulls=True).over(before).alias(name))


def totals_before(rows: DataFrame, by: list[str], n: str) -> DataFrame:
    """(by, part, _before, _size, _total): sums of ``n`` in the group's earlier partitions, in this one and in all."""
    per = rows.groupBy(*by, PART).agg(F.sum(n).alias("_size"))
    upto = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*by, PART, (F.sum("_size").over(upto) - F.col("_size")).alias("_before"), "_size", F.sum("_size").over(Window.partitionBy(*by)).alias("_total"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(b[f"_r_{k}"])
    return left.join(b, on, how).drop(*[f"_r_{k}" for k in keys])
