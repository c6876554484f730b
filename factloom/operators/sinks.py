"""Reports as files: rows in one global order, written in parallel, with a frame around them.

Parts are numbered by their range of the order, so reading them by name gives the report. The last commit of the write makes
the whole folder visible, or nothing.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import ranges
from factloom.operators.report import LEVELS

ORDER = "struct<a:string,b:long,c:string,d:string>"
PLACE = "_place"


def place(file: Column | None = None, line: Column | None = None, symbol: Column | None = None, definition: Column | None = None) -> Column:
    """The canonical order of findings as one value; missing parts come first."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = [("a", file, "string"), ("b", line, "long"), ("c", symbol, "string"), ("d", definition, "string")]
    return F.struct(*[(none(k) if c is None else c.cast(k)).alias(n) for n, c, k in parts])


def write_framed(spark: SparkSession, path: str, sections: list[tuple[str, DataFrame | None, str]], separator: str = ",") -> None:
    """A folder of text lines: for each section its opening line, its rows (_place, value) in order, its closing line.

    All rows but a section's first begin with the separator. Ties of _place are ordered by value.
    """
    frame = lambda k, end, text: spark.createDataFrame([(k, end, text)], "_section int, _end int, value string").select("_section", "_end", F.lit(None).cast(ORDER).alias(PLACE), "value")
    lines = []
    for k, (opening, rows, closing) in enumerate(sections):
        lines += [frame(k, 0, opening), frame(k, 2, closing)]
        if rows is not None:
            lines.append(rows.select(F.lit(k).alias("_section"), F.lit(1).alias("_end"), F.col(PLACE).cast(ORDER).alias(PLACE), "value"))
    every = reduce(DataFrame.unionByName, lines).filter("value is not null")
    keys = ["_section", "_end", PLACE, "value"]
    dealt = ranges.ranged(every, [], keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    dealt = ranges.cut(dealt)
    first = dealt.filter("_end = 1").groupBy("_section").agg(F.min("_id").alias("_first"))
    marked = dealt.join(F.broadcast(first), "_section", "left")
    text = F.when((F.col("_end") == 1) & (F.col("_id") != F.col("_first")), F.concat(F.lit(separator), "value")).otherwise(F.col("value"))
    marked.sortWithinPartitions("_id").select(text.alias("value")).write.mode("overwrite").text(path)


def read_framed(spark: SparkSession, path: str) -> list[str]:
    """The lines of a framed report in order; for tests and small reports."""
    rows = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("f"), F.monotonically_increasing_id().alias("i"))
    return [r["value"] for r in rows.orderBy("f", "i").collect()]


def write_sarif(findings: DataFrame, path: str, tool: str, health: str = "complete", incomplete: DataFrame | None = None) -> None:
    """A SARIF log of findings (id, file, line, classification, confidence, definition_id, symbol_id, logical_fingerprint,
    physical_fingerprint) and of incomplete sources (file, line, message): one run with its rules, results and properties.

    Rules are the classifications that occur. The lines together are one JSON document.
    """
    spark = findings.sparkSession
    rule = lambda name: F.to_json(F.struct(name.alias("id"), name.alias("name"), F.struct(F.concat(F.lit(f"{tool} "), name).alias("text")).alias("shortDescription")))
    rules = findings.select("classification").distinct().select(place(symbol=F.col("classification")).alias(PLACE), rule(F.col("classification")).alias("value"))
    level = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in LEVELS.items()])
    at = lambda: F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    properties = F.struct(F.col("symbol_id").alias("symbolId"), F.col("definition_id").alias("definitionId"), F.col("logical_fingerprint").alias("logicalFingerprint"), F.col("physical_fingerprint").alias("physicalFingerprint"))
    message = F.format_string("%s is %s (%s)", "id", "classification", "confidence")
    result = F.struct(F.col("classification").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), properties.alias("properties"), at().alias("locations"), F.struct(F.col("logical_fingerprint").alias("logical")).alias("partialFingerprints"))
    results = findings.select(place(F.col("file"), F.col("line"), F.col("id"), F.col("definition_id")).alias(PLACE), F.to_json(result).alias("value"))
    if incomplete is not None:
        one = F.lit("parse_incomplete")
        rules = rules.unionByName(incomplete.limit(1).select(place(symbol=F.lit("￿")).alias(PLACE), rule(one).alias("value")))
        told = F.struct(one.alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), at().alias("locations"))
        results = results.unionByName(incomplete.select(place(F.concat(F.lit("￿"), "file"), F.col("line")).alias(PLACE), F.to_json(told).alias("value")))
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1]
    closing = '],"properties":' + json.dumps({"analysisHealth": health}) + "}]}"
    write_framed(spark, path, [(f'{head}, "runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":[', rules, "]}},"), ('"results":[', results, closing)])


def write_report(findings: DataFrame, path: str, facts: dict | None = None) -> None:
    """A JSON report: facts of the whole report, then findings (file, line, id, definition_id and more) in order with their place as a node."""
    own = ("definition_id", "id", "file", "line")
    value = F.to_json(F.struct(F.struct(*[c for c in own if c in findings.columns]).alias("node"), *[c for c in findings.columns if c not in own]))
    rows = findings.select(place(F.col("file"), F.col("line"), F.col("id"), F.col("definition_id")).alias(PLACE), value.alias("value"))
    head = json.dumps(facts or {}, sort_keys=True)[:-1]
    write_framed(findings.sparkSession, path, [(head + (', "findings":[' if facts else '"findings":['), rows, "]}")])
