"""Edges of given callers, precedence among edge sources, counts of a graph, macro rollups and choices among candidate names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.evidence import relations


def outgoing(callers: DataFrame, edges: DataFrame, evidence: DataFrame, projection: str) -> DataFrame:
    """(caller_id, callee_id, evidence_ids): the edges that leave ``callers`` (definition_id) and have evidence in the projection.

    ``edges`` (caller_id, callee_id, evidence_id), ``evidence`` as in ``relations``. Callers come first, so evidence meets
    the asked edges only; Spark splits the rows of a hot caller.
    """
    asked = edges.join(callers.select(F.col("definition_id").alias("caller_id")).distinct(), "caller_id", "left_semi")
    return relations(asked, evidence, projection)


def preferred_edges(structured: DataFrame, legacy: DataFrame) -> DataFrame:
    """(caller, callee, source): all structured edges, and legacy ones whose pair of symbols no structured edge has.

    A pair with a NULL is no pair: such edges never hide another and are never hidden.
    """
    pairs = structured.select("caller", "callee").dropna().distinct()
    rest = legacy.select("caller", "callee").join(pairs, ["caller", "callee"], "left_anti")
    return structured.select("caller", "callee", F.lit("structured").alias("source")).unionByName(rest.withColumn("source", F.lit("legacy")))


def counts(nodes: DataFrame, sites: DataFrame, edges: DataFrame, blockers: DataFrame, request: list[str]) -> DataFrame:
    """One row: definitions, call_sites, edges (distinct ends), blockers, shared_lookups.

    A lookup is made once for each distinct ``request`` of the sites; shared_lookups counts the sites that took another's.
    """
    n = F.count(F.lit(1))
    parts = [("definitions", nodes.agg(n)), ("call_sites", sites.agg(n)), ("edges", edges.select("caller_id", "callee_id").distinct().agg(n)), ("blockers", blockers.agg(n)), ("lookups", sites.select(*request).distinct().agg(n))]
    rows = None
    for name, part in parts:
        one = part.toDF("n").select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name, _ in parts])
    return wide.select("definitions", "call_sites", "edges", "blockers", (F.col("call_sites") - F.col("lookups")).alias("shared_lookups"))


def generated_macros(nodes: DataFrame, prefix: str = "rails_") -> DataFrame:
    """(file, line, owner, macro, n_methods, methods): the methods that one macro call generated, as sorted distinct names."""
    made = nodes.filter(F.coalesce(F.col("defined_via").startswith(prefix), F.lit(False)))
    macro = F.substring("defined_via", len(prefix) + 1, 1 << 20).alias("macro")
    return made.groupBy("file", "line", "owner", macro).agg(F.count(F.lit(1)).alias("n_methods"), F.array_sort(F.collect_set("name")).alias("methods"))


def skip_counts(files: DataFrame) -> DataFrame:
    """(reason, n) of the files that a scan skipped; files without a reason were read."""
    return files.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def first_known(groups: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """(key, candidate): of each group's ordered ``candidates`` the first that is ``known`` (candidate), else the first.

    One exploded row a candidate meets the known names; a partial minimum of positions keeps each group's choice. Groups
    without candidates have no row.
    """
    placed = groups.select(*key, F.posexplode("candidates").alias("pos", "candidate"))
    names = known.select("candidate", F.lit(0).alias("_new")).distinct()
    rank = F.struct(F.coalesce("_new", F.lit(1)), "pos")
    return placed.join(names, "candidate", "left").groupBy(*key).agg(F.min_by("candidate", rank).alias("candidate"))
