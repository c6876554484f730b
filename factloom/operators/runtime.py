"""Runtime observations: interval joins, path suffixes, precedence of sources and merged counts. Positive-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import ranges
from factloom.operators.common import cut, dealt


SIDE = 8192  # hits, and spans, of one range that meet in one cell at most


def line_interval_join(hits: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """hits (file, line, ...) within spans (file, first, last, ...): distinct lines meet distinct ranges by file and line bucket.

    A range is repeated for each bucket of ``width`` lines that it touches, a line stands in one bucket, so no pair of a
    file's lines and ranges is formed unless they are near. Hits then meet the spans of their ranges, of which a cell has
    ``SIDE`` a side at most, dealt by chance: pairs are formed last, are all of the result, and no task holds a large range whole.
    """
    at = ["file", "first", "last"]
    line, place = F.floor(F.col("line") / width), F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))
    asked = hits.groupBy("file", "line").agg(F.count(F.lit(1)).alias("_hits"))
    held = spans.groupBy(*at).agg(F.count(F.lit(1)).alias("_spans"))
    near = asked.withColumn("_bucket", line).join(held.withColumn("_bucket", F.explode(place)), ["file", "_bucket"]).filter("line between first and last")
    near = cut(near.select("file", "line", "first", "last", "_hits", "_spans"))
    sizes = near.groupBy(*at).agg(F.ceil(F.sum("_hits") / SIDE).alias("_wide"), F.ceil(F.max("_spans") / SIDE).alias("_tall"))
    chance = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = [c for c in spans.columns if c != "file"]
    cells = spans.join(sizes, at).select(*at, "_wide", F.struct(*rest).alias("_span"), chance("_tall").alias("_y"))
    cells = cells.groupBy(*at, "_wide", "_y").agg(F.collect_list("_span").alias("_held")).select(*at, "_y", "_held", every("_wide").alias("_x"))
    own = F.struct(*hits.columns).alias("_hit")
    met = hits.select("file", "line", own).join(near.select("file", "line", "first", "last").join(sizes, at), ["file", "line"])
    met = met.select(*at, "_hit", "_tall", chance("_wide").alias("_x")).select(*at, "_hit", "_x", every("_tall").alias("_y"))
    cell = [*at, "_x", "_y"]
    pairs = dealt(met, *cell).join(dealt(cells, *cell), cell).select("_hit", F.explode("_held").alias("_span"))
    return pairs.select("_hit.file", *[F.col(f"_hit.{c}").alias(c) for c in hits.columns if c != "file"], "_span.*")


def coverage_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, path): the covered paths that stand for each project file.

    Those equal to the file, with or without a leading ``./``, win; a file without one has all paths that end with it
    at a path boundary. ``files`` (file), ``paths`` (path). Nulls match nothing.
    """
    known = files.select("file").filter("file is not null").distinct()
    exact = paths.select("path", F.regexp_replace("path", "^\\./", "").alias("file")).join(known, "file").select("file", "path").distinct()
    rest = known.join(exact.select("file"), "file", "left_anti")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = paths.filter(F.size(parts) > 1).select("path", F.explode(tails).alias("file")).join(rest, "file").select("file", "path").distinct()
    return exact.unionByName(ends)


def prefer(rows: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Rows of the best (smallest) priority of each key: structured references replace legacy ones."""
    best = rows.groupBy(*key).agg(F.min(priority).alias("_best"))
    return rows.join(best, key).filter(F.col(priority) == F.col("_best")).drop("_best")


def merge_counts(payloads: DataFrame, key: list[str], count: str) -> DataFrame:
    """Associative merge of observation payloads: counts add up, first and last times widen."""
    return payloads.groupBy(*key).agg(F.sum(count).alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def latest_run(payloads: DataFrame, key: list[str], run: str) -> DataFrame:
    """A new run replaces the earlier ones of its key."""
    return payloads.join(payloads.groupBy(*key).agg(F.max(run).alias(run)), [*key, run], "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: both sides in one ordered pass, no pairs.

    Rows are range-partitioned by key and time, so a key of any size lies in many tasks; each takes over the last value of the
    key's earlier partitions.
    """
    union = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    union = union.unionByName(right.select(F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(union.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value")))
    rows = ranges.ranged(union, ["_key"], ["_ts", "_side", F.xxhash64("_row")])
    seen = Window.partitionBy("_key", ranges.PART).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(seen)).filter("_side = 1")
    before = ranges.carried(rows, ["_key"], F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_ts"))), "_carried")
    told = ranges.null_safe(local, before, ["_key", ranges.PART], "left")
    known = F.when(F.col("_key").isNotNull(), F.coalesce("_last", "_carried"))
    return told.select("_row.*", known.alias(f"latest_{value}"))


def parent_edges(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(parent, child, n): consecutive calls of one thread, counted. A thread of any size lies in many tasks; see ``ranges``."""
    rows = ranges.ranged(calls.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "name"), ["_key"], [f"_o{i}" for i in range(len(order))])
    at = F.struct(*[f"_o{i}" for i in range(len(order))])
    local = rows.withColumn("_lag", F.lag("name").over(Window.partitionBy("_key", ranges.PART).orderBy(at, "name")))
    local = local.withColumn("_first", F.row_number().over(Window.partitionBy("_key", ranges.PART).orderBy(at, "name")) == 1)
    before = ranges.carried(rows, ["_key"], F.max_by("name", F.struct(at, "name")), "_carried")
    told = ranges.null_safe(local, before, ["_key", ranges.PART], "left").withColumn("parent", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
    return told.filter("parent is not null").groupBy("parent", F.col("name").alias("child")).agg(F.count(F.lit(1)).alias("n"))


def executed_lines(counts: Column) -> Column:
    """Executed line numbers of an array of counts by position; an array of positive values only lists the lines itself."""
    positive = F.forall(counts, lambda x: F.coalesce(x > 0, F.lit(False)))
    placed = F.filter(F.transform(counts, lambda x, i: F.when(x > 0, (i + 1).cast("long"))), lambda x: x.isNotNull())
    return F.when(positive, F.array_distinct(counts.cast("array<long>"))).otherwise(placed)
