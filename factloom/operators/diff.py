"""The difference of two reports: ten sets of changes, and the witnesses of what became unreachable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import fixpoint, guard, incremental
from factloom.operators.report import bounded

PROOFS = ("source", "load", "dispatch", "framework", "external_contract", "dynamic_evidence")


@dataclass
class Report:
    """findings (definition_id, classification, actionability, n_blockers), nodes (definition_id, symbol_id, visibility), edges
    (caller_id, callee_id, call_site_id, n_evidence), roots (definition_id), resolutions (call_site_id, status, seq), load_units (unit),
    and facts of the whole report, NULL where they are missing."""

    findings: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    resolutions: DataFrame
    load_units: DataFrame
    root: str | None = None
    configuration: str | None = None
    health: str = "unknown"
    verification: str | None = None


def comparable(base: Report, head: Report) -> list[str]:
    """Why two reports cannot be compared; empty: they can."""
    reasons = []
    for name, a, b in (("root", base.root, head.root), ("configuration", base.configuration, head.configuration)):
        if not a or not b:
            reasons.append(f"{name}_missing")
        elif a != b:
            reasons.append(f"{name}_mismatch")
    return reasons


def _graph(report: Report) -> DataFrame:
    return report.edges.filter("n_evidence > 0").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()


def _roots(report: Report) -> DataFrame:
    return report.roots.select(F.lit("all").alias("domain"), F.col("definition_id").alias("node")).distinct()


def head_reach(base: Report, head: Report, base_reach: DataFrame | None = None) -> DataFrame:
    """(definition_id) of the head's nodes that its roots reach, derived from the base's reachability by the edges that differ.

    ``base_reach`` (domain 'all', node, pred): kept from the last comparison; without it the base is walked first.
    """
    before = fixpoint.reach(_graph(base), _roots(base)) if base_reach is None else base_reach
    edges, removed, added = incremental.edge_delta(_graph(base), _graph(head))
    after, _ = incremental.update_reach(before, edges, removed, added, _roots(head))
    return after.select(F.col("node").alias("definition_id")).join(head.nodes.select("definition_id").distinct(), "definition_id", "left_semi")


def compare(base: Report, head: Report, base_reach: DataFrame | None = None) -> DataFrame:
    """(change, subject, before, after): every change of the ten sets, one row each.

    newly_unreachable and newly_reachable are only named for comparable reports and a complete head. Subjects are definitions, call
    sites, load units, or 'report' for what is true of a whole report.
    """
    row = lambda df, change, subject, before=None, after=None: df.select(F.lit(change).alias("change") if isinstance(change, str) else change.alias("change"), F.col(subject).cast("string").alias("subject"), _text(before).alias("before"), _text(after).alias("after"))
    sure = not comparable(base, head) and head.health == "complete"
    spark = base.findings.sparkSession
    reached = head_reach(base, head, base_reach) if sure else spark.createDataFrame([], head.nodes.select("definition_id").schema)
    found = guard.causal_diff(base.findings, head.findings, reached, sure, sure)
    partial = guard.dispatch_became_partial(base.resolutions, head.resolutions)
    only = lambda a, b, c: a.select(c).filter(f"{c} is not null").distinct().join(b.select(c).distinct(), c, "left_anti")
    parts = [
        row(found, F.col("change"), "definition_id"),
        row(only(base.roots, head.roots, "definition_id"), "entry_point_removed", "definition_id"),
        row(only(head.load_units, base.load_units, "unit"), "load_unit_unrooted", "unit"),
        row(partial, "dispatch_became_partial", "call_site_id", "from", "to"),
        surface(base.nodes, head.nodes),
    ]
    whole = []
    if base.health != head.health:
        whole.append(("analysis_health_changed", "report", base.health, head.health))
    if base.verification == "match" and head.verification != "match":
        whole.append(("runtime_evidence_invalidated", "report", base.verification, head.verification))
    parts.append(spark.createDataFrame(whole, "change string, subject string, before string, after string"))
    return reduce(DataFrame.unionByName, parts)


def _text(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else F.col(name).cast("string")


def surface(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change, subject, before, after): public or protected definitions that came, went, or changed symbol or visibility."""
    open_ = F.col("visibility").isin("public", "protected")
    side = lambda df, name: df.filter(open_).groupBy("definition_id").agg(F.max(F.concat_ws(" ", "visibility", F.coalesce("symbol_id", F.lit("")))).alias(name))
    both = side(base, "before").join(side(head, "after"), "definition_id", "full").filter("not before <=> after")
    change = F.when(F.col("before").isNull(), "public_surface_added").when(F.col("after").isNull(), "public_surface_removed").otherwise("public_surface_visibility_changed")
    return both.select(change.alias("change"), F.col("definition_id").cast("string").alias("subject"), "before", "after")


def witnesses(changes: DataFrame, base: Report, head: Report, limit: int = 100) -> DataFrame:
    """(definition_id, base_incoming, head_incoming, removed_incoming, last_incoming, proof_obligations) of newly unreachable definitions.

    Incoming edges (caller_id, call_site_id) are in order, the first ``limit`` with the number of all; last_incoming is the last of
    the head's, or of the base's if the head has none. Only edges into changed definitions are grouped.
    """
    wanted = changes.filter("change = 'newly_unreachable'").select(F.col("subject").alias("callee_id")).distinct()
    side = lambda r, b, h: r.edges.select(F.col("callee_id").cast("string").alias("callee_id"), F.col("caller_id").cast("string").alias("caller_id"), F.col("call_site_id").cast("string").alias("call_site_id"), F.lit(b).alias("_b"), F.lit(h).alias("_h"))
    edges = side(base, 1, 0).unionByName(side(head, 0, 1)).join(wanted, "callee_id", "left_semi")
    edges = edges.groupBy("callee_id", "caller_id", "call_site_id").agg(F.max("_b").alias("_b"), F.max("_h").alias("_h"))
    edge = F.struct(F.coalesce("caller_id", F.lit("")).alias("caller_id"), F.coalesce("call_site_id", F.lit("")).alias("call_site_id"))
    kept = lambda when: bounded(F.array_sort(F.collect_list(F.when(when, edge))), limit)
    per = edges.groupBy("callee_id").agg(kept(F.col("_b") == 1).alias("base_incoming"), kept(F.col("_h") == 1).alias("head_incoming"), kept((F.col("_b") == 1) & (F.col("_h") == 0)).alias("removed_incoming"), F.max(F.when(F.col("_h") == 1, edge)).alias("_lh"), F.max(F.when(F.col("_b") == 1, edge)).alias("_lb"))
    told = wanted.join(per, "callee_id", "left")
    return told.select(F.col("callee_id").alias("definition_id"), "base_incoming", "head_incoming", "removed_incoming", F.coalesce("_lh", "_lb").alias("last_incoming"), F.array(*[F.lit(p) for p in PROOFS]).alias("proof_obligations"))
