"""Measurement: precision, recall, macro averages, tool matrices and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.scalars import nearest_rank, nullable_ratio, ratio
from factloom.operators import ranges


def retrieval(rows: DataFrame, by: list[str], predicted: Column, positive: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by group, 0.0 for an empty denominator."""
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(predicted & positive, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted & ~positive, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~predicted & positive, 1).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = sums.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nullable_precision(rows: DataFrame, by: list[str], predicted: Column, positive: Column) -> DataFrame:
    """n_labeled, precision (NULL without candidates) and precision_status by group."""
    sums = rows.groupBy(*by).agg(F.sum(F.when(predicted, 1).otherwise(0)).alias("n_labeled"), F.sum(F.when(predicted & positive, 1).otherwise(0)).alias("n_true"))
    precision = nullable_ratio(F.col("n_true"), F.col("n_labeled"))
    return sums.select(*by, "n_labeled", precision.alias("precision"), F.when(F.col("n_labeled") == 0, "unlabeled").otherwise("measured").alias("precision_status"))


def macro(parts: DataFrame, value: str) -> DataFrame:
    """Mean of values that are rounded already, NULLs left out, rounded again."""
    exact = F.round(value, 4).cast("decimal(18,4)")  # the mean of decimals is exact, so that a tie rounds up
    return parts.agg(F.round(F.avg(exact), 4).cast("double").alias("macro"), F.count(value).alias("n_parts"))


def tool_matrix(rows: DataFrame, by: str, tool: str, tools: list[str]) -> DataFrame:
    """Counts of candidates by group and tool, one column for each listed tool."""
    return rows.groupBy(by).pivot(tool, tools).agg(F.count(F.lit(1))).select(by, *[F.coalesce(t, F.lit(0)).alias(t) for t in tools])


def distribution(rows: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """count, low, high, mean and nearest-rank percentiles (p50, p95) by group. Exact, and no task holds a whole group.

    Distinct values with their counts are range-partitioned by group and value; the totals of a group's partitions say in
    which of them a rank lies, and only that one is ordered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cells = ranges.ranged(counts, by, ["_v"])
    parts = ranges.totals_before(cells, by, "_n")
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("_p"), F.greatest(F.ceil(F.col("_total") * F.lit(p) / 100.0), F.lit(1)).alias("_rank")) for p in percents]))
    wanted = parts.select("*", ranks.alias("_r")).select(*by, ranges.PART, "_before", "_size", "_r.*").filter("_rank > _before and _rank <= _before + _size")
    near = ranges.null_safe(cells, wanted, [*by, ranges.PART])
    upto = Window.partitionBy(*by, ranges.PART, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = near.withColumn("_upto", F.sum("_n").over(upto) + F.col("_before")).filter("_upto >= _rank").groupBy(*by, "_p").agg(F.min("_v").alias("_v"))
    points = hit.groupBy(*by).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])
    plain = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.round(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n"), 4).alias("mean"))
    return ranges.null_safe(plain, points, by)


def performance_gate(measured: DataFrame, limits: DataFrame, corpus: str, values: list[str]) -> DataFrame:
    """(corpus, metric, value, cap, passed): every limit beside its measurement; one that was not measured fails.

    ``limits`` has the columns of ``measured``; a NULL limit is no limit and gives no row.
    """
    long = lambda rows, name: rows.unpivot([corpus], values, "metric", name)
    joined = long(limits, "cap").filter("cap IS NOT NULL").join(long(measured, "value"), [corpus, "metric"], "left")
    return joined.select(corpus, "metric", "value", "cap", F.coalesce(F.col("value") <= F.col("cap"), F.lit(False)).alias("passed"))


__all__ = ["retrieval", "nullable_precision", "macro", "tool_matrix", "distribution", "performance_gate", "nearest_rank"]
