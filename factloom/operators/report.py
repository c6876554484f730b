"""Reports: filters, canonical orders, summaries and sinks. Everything here applies after scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import annotation_escape, rank_of

ACTIONABILITY = ("diagnostic", "review_candidate", "verified_candidate")
#: Fixed canonical orders.
ORDERS = {
    "findings": ["file", "line", "id", "definition_id"],
    "edges": ["caller_id", "callee_id"],
    "definitions": ["symbol_id", "file", "line", "definition_id"],
    "resolutions": ["call_site_id", "status", "producer", "producer_version", "target_definition_ids"],
    "normalised": ["id", "path", "line", "definition_id"],
    "candidates": ["corpus", "id", "definition_id"],
}
#: Fixed levels by confidence.
LEVELS = {"certain": "error", "high": "error", "medium": "warning", "low": "note"}


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in their canonical order, by the columns of it that they have."""
    return rows.orderBy(*[c for c in ORDERS[kind] if c in rows.columns])


def actionable(min_confidence: str, min_actionability: str | None = None) -> Column:
    """A candidate that is actionable enough or sure enough."""
    sure = rank_of(F.col("confidence")) >= rank_of(F.lit(min_confidence))
    if min_actionability is not None:
        levels = F.array(*[F.lit(x) for x in ACTIONABILITY])
        sure = sure | (F.array_position(levels, F.col("actionability")) >= ACTIONABILITY.index(min_actionability) + 1)
    return F.coalesce((F.col("actionability") != "diagnostic") & sure, F.lit(False))


def split(findings: DataFrame, min_confidence: str) -> dict[str, DataFrame]:
    """actionable, blocked and diagnostic findings: every finding is in one of them."""
    blocked, act = F.col("classification") == "blocked", actionable(min_confidence)
    return {"actionable": findings.filter(act & ~blocked), "blocked": findings.filter(blocked), "diagnostic": findings.filter(~act & ~blocked)}


def broken(findings: DataFrame) -> DataFrame:
    """Findings that contradict themselves: a candidate with blockers, or of an analysis that is not complete."""
    return findings.filter((F.col("actionability") != "diagnostic") & ((F.col("n_blockers") > 0) | ~F.coalesce("complete", F.lit(True))))


def summary(findings: DataFrame, min_confidence: str = "low") -> DataFrame:
    """(total, actionable, blocked, diagnostic) and one count for each classification."""
    kinds = ("unreachable", "test_only_reachable", "unused")
    blocked, act = F.col("classification") == "blocked", actionable(min_confidence) & (F.col("classification") != "blocked")
    return findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(act).alias("actionable"), F.count_if(blocked).alias("blocked"), F.count_if(~act & ~blocked).alias("diagnostic"), *[F.count_if(F.col("classification") == k).alias(k) for k in kinds])


def annotations(findings: DataFrame) -> DataFrame:
    """(value): one CI annotation for each finding (file, line, id, classification, confidence)."""
    message = annotation_escape(F.format_string("%s is %s (%s)", "id", "classification", "confidence"))
    return findings.select(F.format_string("::warning file=%s,line=%d::%s", annotation_escape(F.col("file")), "line", message).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): one SARIF result as JSON for each finding; a run is these lines inside a fixed frame."""
    level = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in LEVELS.items()])
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("classification").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" is ", "id", "classification").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def payload(findings: DataFrame) -> DataFrame:
    """(value): one JSON report row for each finding, with its place as a nested node."""
    node = F.struct(*[c for c in ("definition_id", "id", "file", "line") if c in findings.columns])
    rest = [c for c in findings.columns if c not in ("definition_id", "id", "file", "line")]
    return findings.select(F.to_json(F.struct(node.alias("node"), *rest)).alias("value"))


def write_baseline(findings: DataFrame, path: str, min_confidence: str = "low") -> None:
    """Actionable findings as Parquet; Spark's commit makes the table whole or absent."""
    findings.filter(actionable(min_confidence)).write.mode("overwrite").parquet(path)


def bounded(values: Column, limit: int = 100) -> Column:
    """The first ``limit`` of an array with what was left out: items, total, returned, truncated."""
    n = F.size(values)
    return F.struct(F.slice(values, 1, limit).alias("items"), n.alias("total"), F.least(n, F.lit(limit)).alias("returned"), (n > limit).alias("truncated"))


def self_check(nodes: DataFrame, edges: DataFrame, resolutions: DataFrame, findings: DataFrame) -> DataFrame:
    """(issue, n) of the graph's invariants: unknown edge ends, repeated sites, complete sites without an edge, broken findings.

    ``edges`` (caller_id, callee_id, call_site_id), ``resolutions`` (call_site_id, status, n_targets).
    """
    known = nodes.select(F.col("definition_id").alias("_k")).distinct()
    ends = edges.select(F.explode(F.array("caller_id", "callee_id")).alias("_k")).distinct()
    count = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), "n")
    out = count(ends.join(known, "_k", "left_anti"), "unknown_edge_end")
    out = out.unionByName(count(resolutions.groupBy("call_site_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated_site"))
    bare = resolutions.filter("status = 'complete' and n_targets > 0").join(edges.select("call_site_id").distinct(), "call_site_id", "left_anti")
    return out.unionByName(count(bare, "complete_without_edge")).unionByName(count(broken(findings), "broken_finding"))
