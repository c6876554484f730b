"""line_interval_join: one line and one range that all hits and spans share lie in many tasks; pairs are as in a plain join."""

from pyspark.sql import functions as F

from factloom.operators import runtime


def test_hot_ranges_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(runtime, "SIDE", 8, raising=False)
    hot = spark.range(50).select(F.lit("f").alias("file"), F.lit(7).alias("line"), "id")
    rest = spark.createDataFrame([("f", 8, 50), ("f", 20, 51), ("g", 7, 52), (None, 7, 53), ("g", None, 54), ("f", 7, 0)], "file string, line int, id long")
    spans = spark.range(30).select(F.lit("f").alias("file"), F.lit(5).alias("first"), F.lit(7).alias("last"), F.col("id").alias("span"))
    spans = spans.unionByName(spark.createDataFrame([("f", 8, 30, 30), ("g", 7, 6, 31), ("g", 1, 200, 32), ("f", 5, 7, 0), (None, 1, 9, 33), ("g", 1, None, 34)], "file string, first int, last int, span long"))
    hits = hot.unionByName(rest)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = runtime.line_interval_join(hits, spans)
        got = met.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    s, h = spans.collect(), hits.collect()
    fits = lambda a, b: None not in (a.file, a.line, b.first, b.last) and a.file == b.file and b.first <= a.line <= b.last
    assert sorted((r.file, r.line, r.id, r.first, r.last, r.span) for r in got) == sorted((a.file, a.line, a.id, b.first, b.last, b.span) for a in h for b in s if fits(a, b))
    assert len({r.task for r in got if r.span < 30}) > 1
