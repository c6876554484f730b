"""Fact relations as NDJSON envelopes ({schema, record, data}) and Parquet, with explicit schemas."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "factgraph.ndjson.v1"
SCHEMAS = {
    "node": "definition_id string, symbol_id string, kind string, file string, line int, end_line int, owner string, name string, test boolean, visibility string",
    "call_site": "call_site_id string, caller_id string, message string, receiver_kind string, receiver_name string, file string, line int, test boolean, dynamic boolean",
    "edge": "caller_id string, callee_id string, evidence_id string",
    "edge_relation": "caller_id string, callee_id string, evidence_ids array<string>",
    "evidence": "evidence_id string, analyzer string, kind string, weight double, grade string, details string",
    "entry_point": "definition_id string, domain string, reason string",
    "class_info": "id string, kind string, superclass string, includes array<string>, prepends array<string>, singleton_includes array<string>, singleton_prepends array<string>, dynamic boolean",
    "profile": "name string, kind string, version string, assumptions array<string>",
    "resolution": "call_site_id string, status string, producer string, target_definition_ids array<string>",
    "blocker": "blocker_id string, kind string, scope_kind string, scope_value string, scope_match string",
    "source_error": "file string, line int, message string",
}
#: Fixed first and last records of an export.
HEADER, TRAILER = "report", "graph_metadata"


def read_ndjson(spark: SparkSession, path: str, version: str = VERSION) -> dict[str, DataFrame]:
    """One DataFrame for each relation of lines {schema, record, data}; unknown records are left alone.

    Bad lines, and lines of another version, fail the read of any relation.
    """
    lines = spark.read.schema("schema string, record string, data string").option("mode", "FAILFAST").json(path)
    wrong = F.raise_error(F.concat(F.lit("unknown version of the export: "), F.coalesce("schema", F.lit("none")))).cast("string")
    record = F.when(F.col("schema") == version, F.col("record")).otherwise(wrong)
    return {name: lines.filter(record == name).select(F.from_json("data", ddl).alias("d")).select("d.*") for name, ddl in SCHEMAS.items()}


def write_ndjson(relations: dict[str, DataFrame], path: str, report: dict | None = None, metadata: dict | None = None, version: str = VERSION) -> None:
    """A folder of NDJSON lines: the report's header, all relations in the order of ``SCHEMAS``, and a trailer of metadata."""
    spark = next(iter(relations.values())).sparkSession
    envelope = lambda name, data: F.to_json(F.struct(F.lit(version).alias("schema"), F.lit(name).alias("record"), data.alias("data"))).alias("value")
    frame = lambda name, values: spark.createDataFrame([(json.dumps({"schema": version, "record": name, "data": values or {}}),)], "value string")
    parts = [frame(HEADER, report)] + [relations[name].select(envelope(name, F.struct("*"))) for name in SCHEMAS if name in relations] + [frame(TRAILER, metadata)]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of all files under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def snapshot_digest(files: DataFrame, buckets: int = 4096) -> DataFrame:
    """(digest, n_files) of (path, content) rows, whatever their order.

    Each row's digest covers its length-prefixed path and content, in which null is not the empty text. Digests are sorted and
    hashed inside buckets by their first bits, and then the buckets', so no list holds all files.
    """
    sized = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)))
    each = files.select(F.sha2(F.concat(sized("path"), F.lit("|"), sized("content")), 256).alias("_d"))
    inside = each.groupBy(F.pmod(F.xxhash64("_d"), F.lit(buckets)).alias("_b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), ""), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "")
    return inside.agg(F.sha2(listed, 256).alias("digest"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_files"))
