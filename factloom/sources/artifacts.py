"""Artifacts of other runs and tools as tables: JSON documents with a schema and limits each, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
#: Schemas by kind: the document's columns, and the array that holds its rows.
KINDS = {
    "baseline": ("schema_version string, version string, findings array<struct<fingerprint:string,definition_id:string,symbol_id:string,path:string,body_digest:string,classification:string>>", "findings"),
    "gold": ("schema_version string, labels array<struct<corpus:string,id:string,definition_id:string,label:string,reviewer:string,note:string>>", "labels"),
    "tool": ("tool string, tool_version string, corpus string, candidates array<struct<id:string,path:string,line:long,kind:string>>", "candidates"),
    "trace": ("schema_version string, nodes array<string>, edges array<struct<caller_id:string,callee_id:string>>, observation struct<run_id:string,started_at:string,finished_at:string,sample_rate:double>", "edges"),
}
#: Fixed versions that a baseline may have.
BASELINE_VERSIONS = (1, 2)


def documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, body) of all files below a path. Larger files than ``max_bytes`` raise before their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = F.raise_error(F.concat(F.lit(f"an artifact has more than {max_bytes} bytes: "), "path")).cast("string")
    return files.select("path", F.when(F.col("length") > max_bytes, large).otherwise(F.decode("content", "UTF-8")).alias("body"))


def read_artifact(spark: SparkSession, path: str, kind: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row for each entry of the artifacts of a kind: artifact (its file), the document's other columns, and the entry's.

    A file that is no JSON object, or lacks the kind's array, raises with its name; so does a baseline whose two versions differ or are
    none that is known. A baseline without a version has version 1.
    """
    schema, rows = KINDS[kind]
    told = documents(spark, path, max_bytes).select("path", "body", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("d"))
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"not a {kind} artifact, {why}: "), F.col("path")))
    array = F.get_json_object("body", f"$.{rows}")
    whole = F.when(F.get_json_object("body", "$").isNull() | ~F.ltrim("body").startswith("{"), wrong("no JSON object").cast("string")).when(~F.coalesce(array.startswith("["), F.lit(False)), wrong(f"no array {rows}").cast("string")).otherwise("fine")
    out = told.filter(whole == "fine").select(F.col("path").alias("artifact"), "d.*")
    if kind == "baseline":
        explicit, legacy = F.col("schema_version").try_cast("int"), F.col("version").try_cast("int")
        bad = (F.col("schema_version").isNotNull() & explicit.isNull()) | (F.col("version").isNotNull() & legacy.isNull()) | F.coalesce(explicit != legacy, F.lit(False))
        version = F.coalesce(explicit, legacy, F.lit(1))
        refused = F.raise_error(F.concat(F.lit("a baseline's version cannot be read: "), F.col("artifact"))).cast("int")
        out = out.withColumn("schema_version", F.when(bad | ~version.isin(*BASELINE_VERSIONS), refused).otherwise(version)).drop("version")
    rest = [c for c in out.columns if c != rows]
    return out.select(*rest, F.explode(rows).alias("_r")).select(*rest, "_r.*")
