"""Answers about definitions: why one is alive or dead, what its score is made of, what speaks against it, and checks of a whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import cut, dealt
from factloom.operators.fixpoint import witness_paths
from factloom.operators.report import bounded

#: Fixed names of ordinary definitions and of the proofs that a removal asks for.
ORDINARY = ("def", "defs", "define_method")
PROOFS = ("source", "load", "dispatch", "framework", "external_contract", "dynamic_evidence")
STATUSES = ("complete", "partial", "unknown", "unrecorded")


def why_status() -> Column:
    """(status, kind) of a node with flags runtime, external, blocked, test: a runtime or external path, then a blocker, then a test path."""
    told = lambda status, kind: F.struct(F.lit(status).alias("status"), F.lit(kind).cast("string").alias("kind"))
    return F.when(F.col("runtime"), told("alive", "runtime")).when(F.col("external"), told("alive", "external")).when(F.col("blocked"), told("blocked", None)).when(F.col("test"), told("alive", "test")).otherwise(told("dead", None))


def why(nodes: DataFrame, reached: DataFrame, blocked: DataFrame) -> DataFrame:
    """(definition_id, status, kind, path): alive nodes have a witness path from a root of their domain.

    ``nodes`` (definition_id), ``reached`` (domain, node, pred) as ``fixpoint.reach`` gives it, ``blocked`` (definition_id).
    """
    flags = reached.groupBy(F.col("node").alias("definition_id")).agg(*[F.max(F.col("domain") == d).alias(d) for d in ("runtime", "external", "test")])
    held = blocked.select("definition_id").distinct().withColumn("blocked", F.lit(True))
    told = nodes.select("definition_id").join(flags, "definition_id", "left").join(held, "definition_id", "left").fillna(False)
    told = cut(told.select("definition_id", why_status().alias("s")).select("definition_id", "s.*"))
    paths = [witness_paths(reached.filter(F.col("domain") == d), told.filter(F.col("kind") == d).select(F.col("definition_id").alias("node"))) for d in ("runtime", "external", "test")]
    return told.join(reduce(DataFrame.unionByName, paths).withColumnRenamed("node", "definition_id"), "definition_id", "left")


def path_steps(paths: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(definition_id, step, node, reason, caller_id, evidence_ids): witness paths with their edges' evidence and their root's reason.

    ``edges`` (caller_id, callee_id, evidence_id), ``roots`` (domain, definition_id, reason); ties of reasons go to the smallest.
    """
    steps = paths.filter("path is not null").select("definition_id", F.col("kind").alias("domain"), F.posexplode("path").alias("step", "node"), "path")
    steps = steps.withColumn("caller_id", F.when(F.col("step") > 0, F.element_at("path", F.col("step")))).drop("path")
    proof = edges.groupBy("caller_id", F.col("callee_id").alias("node")).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    reason = roots.groupBy("domain", F.col("definition_id").alias("node")).agg(F.min("reason").alias("reason"))
    return steps.join(proof, ["caller_id", "node"], "left").join(reason, ["domain", "node"], "left").select("definition_id", "step", "node", "reason", "caller_id", "evidence_ids")


def nearest_alive(edges: DataFrame, alive: DataFrame, asked: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, alive, kind, distance) of asked nodes: the alive node that a breadth-first search along edges of either way meets first.

    ``edges`` (src, dst), ``alive`` (node, kind), ``asked`` (node). Neighbours are visited in the order of their ids, so
    each node takes over the answer of its smallest neighbour that is nearer. A node never answers for itself; asked nodes
    that are alive, or that no alive node can be reached from, give no row.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = cut(both.repartition("src"))
    known = cut(alive.groupBy("node").agg(F.min("kind").alias("kind")).select("node", F.col("node").alias("alive"), "kind", F.lit(0).alias("distance")))
    found, frontier = known, known
    for hop in range(1, max_rounds + 1):
        best = F.min(F.struct("src", "alive", "kind")).alias("b")
        step = frontier.withColumnRenamed("node", "src").join(both, "src").groupBy(F.col("dst").alias("node")).agg(best)
        frontier = cut(step.join(found, "node", "left_anti").select("node", "b.alive", "b.kind", F.lit(hop).alias("distance")))
        if frontier.isEmpty():
            return found.filter("distance > 0").join(asked.select("node").distinct(), "node", "left_semi")
        found = cut(found.unionByName(frontier)) if hop % 8 == 0 else found.unionByName(frontier)
    raise RuntimeError("nearest_alive did not settle")


def explain(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(definition_id, status, classification, confidence, score, components, blockers): nodes without a finding are alive."""
    kept = [c for c in ("classification", "confidence", "score", "components", "blockers") if c in findings.columns]
    told = findings.select("definition_id", *kept, F.lit("finding").alias("status"))
    return nodes.select("definition_id").join(told, "definition_id", "left").withColumn("status", F.coalesce("status", F.lit("alive")))


def asked(ids: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(id, status, definition_id, suggestions): node, ambiguous or not_found; symbols come before ids.

    What is not found has the first ``limit`` symbols that contain it, or its last part after . or #, whatever the case.
    ``ids`` is a bounded list of questions (id); it meets all symbols, once each, as a broadcast.
    """
    symbols = nodes.groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("definition_id").alias("_one"))
    known = nodes.select(F.col("definition_id").alias("id"), F.col("definition_id").alias("_exact")).distinct()
    told = ids.select("id").distinct().join(symbols, "id", "left").join(known, "id", "left")
    one = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n").isNull(), F.col("_exact"))
    told = told.select("id", one.alias("definition_id"), F.when(one.isNotNull(), "node").when(F.col("_n") > 1, "ambiguous").otherwise("not_found").alias("status"))
    lost = told.filter("status = 'not_found'").select("id", F.array_distinct(F.filter(F.array(F.lower("id"), F.lower(F.element_at(F.split("id", "[.#]"), -1))), lambda t: F.length(t) >= 2)).alias("_terms"))
    names = symbols.select(F.col("id").alias("_symbol"))
    near = names.join(F.broadcast(lost), F.exists("_terms", lambda t: F.contains(F.lower("_symbol"), t)))
    first = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("_symbol")), 1, limit).alias("suggestions"))
    return told.join(first, "id", "left").select("id", "status", "definition_id", "suggestions")


def risk_flags() -> Column:
    """Sorted flags of a node (visibility, defined_via, n_same, owner, test, dynamic_owner, n_blockers)."""
    flags = [
        ("analysis_incomplete", F.col("n_blockers") > 0),
        ("duplicate_or_redefinition", F.col("n_same") > 1),
        ("dynamic_owner", F.col("dynamic_owner")),
        ("generated_method", ~F.col("defined_via").isin(*ORDINARY)),
        ("no_owner", F.coalesce("owner", F.lit("")) == ""),
        ("public_or_protected_visibility", F.col("visibility").isin("public", "protected")),
        ("test_definition", F.col("test_definition")),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in flags]))


def state() -> Column:
    """State of a node (classification or NULL; runtime, external, test: reached)."""
    c = F.col("classification")
    found = F.when(c == "blocked", "blocked").when(c == "test_only_reachable", "test_only").when(c.isNotNull(), "candidate")
    return found.when(F.col("runtime"), "runtime_reachable").when(F.col("external"), "external_reachable").when(F.col("test"), "test_only").otherwise("not_classified")


def action(at: Column, risks: Column) -> Column:
    """What to do with a node in a state."""
    keep, look = at.isin("runtime_reachable", "external_reachable"), (at == "blocked") | ((at == "candidate") & (F.size(risks) > 0))
    return F.when(keep, "keep").when(at == "test_only", "observe").when(look, "review").otherwise("verify")


def incoming_sites(nodes: DataFrame, sites: DataFrame, targets: DataFrame) -> DataFrame:
    """(definition_id, call_site_id): sites whose message is the node's name, and sites that resolve to the node.

    ``nodes`` (definition_id, name), ``sites`` (call_site_id, message), ``targets`` (call_site_id, definition_id).
    """
    named = nodes.join(sites.select("call_site_id", F.col("message").alias("name")), "name").select("definition_id", "call_site_id")
    to = targets.join(nodes.select("definition_id").distinct(), "definition_id", "left_semi").select("definition_id", "call_site_id")
    return named.unionByName(to).distinct()


def incoming_counts(nodes: DataFrame, sites: DataFrame, resolutions: DataFrame, targets: DataFrame) -> DataFrame:
    """(definition_id, n_sites and a number for each status): ``incoming_sites`` with their resolutions, counted.

    Sites of a message are counted once and not for each node of that name; what the name does not tell are pairs: targets whose
    site says another message, and all sites of a node that has several names.
    """
    status = lambda df: df.join(resolutions.select("call_site_id", "status"), "call_site_id", "left").fillna("unrecorded", ["status"])
    counted = lambda df, key: status(df).groupBy(key).agg(F.count_distinct("call_site_id").alias("n_sites"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])
    said = sites.select("call_site_id", F.col("message").alias("name")).distinct()
    names = nodes.select("definition_id", "name").distinct()
    several = names.groupBy("definition_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("definition_id")
    one = names.join(several, "definition_id", "left_anti")
    other = targets.select("definition_id", "call_site_id").distinct().join(one, "definition_id").join(said, ["call_site_id", "name"], "left_anti").select("definition_id", "call_site_id")
    pairs = other.unionByName(incoming_sites(names.join(several, "definition_id", "left_semi"), sites, targets))
    parts = one.join(counted(said, "name"), "name").drop("name").unionByName(counted(pairs, "definition_id"))
    return parts.groupBy("definition_id").agg(*[F.sum(c).alias(c) for c in ("n_sites", *[f"n_{s}" for s in STATUSES])])


def why_not(nodes: DataFrame, sites: DataFrame, resolutions: DataFrame, targets: DataFrame, rejected: DataFrame, blockers: DataFrame, limit: int = 100) -> DataFrame:
    """One row for each asked node: state, action, risk_flags, statuses of its incoming sites, rejections and blockers, bounded.

    ``nodes`` is what is asked for (definition_id, name and the columns of ``state`` and ``risk_flags`` but n_blockers);
    ``resolutions`` (call_site_id, producer, status), ``rejected`` (call_site_id, definition_id, reason), ``blockers``
    (definition_id, kind, reason). Collections are sorted and keep ``limit`` items beside their totals; only counts leave
    the sites of a node.
    """
    counts = incoming_counts(nodes, sites, resolutions, targets)
    gone = rejected.groupBy("definition_id").agg(F.array_sort(F.collect_set(F.struct("reason", "call_site_id"))).alias("_r"))
    held = blockers.groupBy("definition_id").agg(F.array_sort(F.collect_set(F.struct("kind", "reason"))).alias("_b"))
    told = nodes.join(counts, "definition_id", "left").join(gone, "definition_id", "left").join(held, "definition_id", "left").fillna(0, ["n_sites", *[f"n_{s}" for s in STATUSES]])
    told = told.withColumn("n_blockers", F.coalesce(F.array_size("_b"), F.lit(0))).withColumn("state", state()).withColumn("risk_flags", risk_flags())
    status = F.struct(*[F.col(f"n_{s}").alias(s) for s in STATUSES]).alias("resolution_status")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    rejections = bounded(none("_r", gone.schema["_r"].dataType), limit).alias("rejections")
    return told.select("definition_id", "state", action(F.col("state"), F.col("risk_flags")).alias("action"), "risk_flags", "n_sites", status, rejections, bounded(none("_b", held.schema["_b"].dataType), limit).alias("blockers"))


def resolution_issues(resolutions: DataFrame, sites: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_site_id, producer, issue, definition_id): unknown or ambiguous sites, unknown targets, targets without an edge.

    ``resolutions`` (call_site_id, producer, target_definition_ids), ``sites`` (call_site_id, caller_id), ``edges``
    (caller_id, callee_id). An edge is only asked for where the site is one and the target is known.
    """
    at = sites.groupBy("call_site_id").agg(F.count(F.lit(1)).alias("_n"), F.min("caller_id").alias("caller_id"))
    placed = resolutions.select("call_site_id", "producer", "target_definition_ids").join(at, "call_site_id", "left")
    wrong = placed.filter("_n is null or _n > 1").select("call_site_id", "producer", F.when(F.col("_n").isNull(), "unknown_call_site").otherwise("ambiguous_call_site").alias("issue"), F.lit(None).cast(nodes.schema["definition_id"].dataType).alias("definition_id"))
    aims = placed.select("call_site_id", "producer", "_n", "caller_id", F.explode("target_definition_ids").alias("definition_id"))
    known = nodes.select("definition_id", F.lit(True).alias("_known")).distinct()
    there = edges.select("caller_id", F.col("callee_id").alias("definition_id"), F.lit(True).alias("_there")).distinct()
    aims = aims.join(known, "definition_id", "left").join(there, ["caller_id", "definition_id"], "left")
    lost = F.when(F.col("_known").isNull(), "unknown_target_definition").when((F.col("_n") == 1) & F.col("_there").isNull(), "missing_target_edge")
    return wrong.unionByName(aims.select("call_site_id", "producer", lost.alias("issue"), "definition_id").filter("issue is not null")).distinct()


def self_check(resolutions: DataFrame, sites: DataFrame, nodes: DataFrame, edges: DataFrame, candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """(code, subject) of broken invariants; an empty result is a sound graph.

    ``resolutions`` (call_site_id, status, unknown_scope, target_definition_ids), ``sites`` (call_site_id, derived_from), ``edges``
    (caller_id, callee_id, evidence_id or NULL), ``candidates`` (definition_id, n_blockers): actionable findings,
    ``matched`` (definition_id): nodes that any blocker matches. A resolution has the first of its issues.
    """
    issue = lambda df, code, subject: df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    scoped = (F.col("status") == "complete") & F.col("unknown_scope").isNotNull()
    rest = resolutions.filter(~F.coalesce(scoped, F.lit(False)))
    ids = dealt(sites.select("call_site_id"), "call_site_id").distinct()
    rest = dealt(rest, "call_site_id")
    aims = rest.join(ids, "call_site_id", "left_semi").select("call_site_id", F.explode("target_definition_ids").alias("definition_id"))
    # what many sites aim at is looked up once: sites meet only the targets that are missing
    asked = rest.select(F.explode("target_definition_ids").alias("definition_id")).distinct()
    missing = asked.join(nodes.select("definition_id").distinct(), "definition_id", "left_anti").withColumnRenamed("definition_id", "_lost")
    nowhere = aims.join(missing, F.equal_null("definition_id", "_lost"), "left_semi")
    derived = dealt(sites.filter("derived_from is not null"), "call_site_id")
    parts = [
        issue(resolutions.filter(scoped), "complete_resolution_has_unknown_scope", F.col("call_site_id")),
        issue(rest.join(ids, "call_site_id", "left_anti"), "resolution_call_site_missing", F.col("call_site_id")),
        issue(nowhere.select("call_site_id").distinct(), "resolution_target_missing", F.col("call_site_id")),
        issue(derived.join(dealt(resolutions.select("call_site_id"), "call_site_id"), "call_site_id", "left_anti"), "derived_call_site_has_no_resolution", F.col("call_site_id")),
        issue(dealt(edges, "caller_id", "callee_id").groupBy("caller_id", "callee_id").agg(F.count("evidence_id").alias("_n")).filter("_n = 0"), "edge_has_no_evidence", F.concat_ws("->", "caller_id", "callee_id")),
        issue(candidates.join(matched.select("definition_id", F.lit(True).alias("_m")).distinct(), "definition_id", "left").filter("n_blockers > 0 or _m"), "actionable_finding_has_matching_blocker", F.col("definition_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def doctor(by_actionability: bool, verified_only: bool, health: DataFrame, scope_issues: DataFrame, unrooted: DataFrame) -> DataFrame:
    """(name, status, severity, n) of four checks: the gate's threshold, the analysis' health, its scopes, its load roots.

    ``health`` (status): one row, complete, degraded or invalid.
    """
    check = lambda df, name, severity, n: df.select(F.lit(name).alias("name"), F.when(severity == "ok", "ok").otherwise("issue").alias("status"), severity.alias("severity"), n.cast("long").alias("n"))
    spark = health.sparkSession
    gate = F.lit("ok" if by_actionability and not verified_only else "warning")
    sick = F.when(F.col("status") == "invalid", "error").when(F.col("status") == "complete", "ok").otherwise("warning")
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    some = F.when(F.col("n") > 0, "warning").otherwise("ok")
    parts = [check(spark.range(1), "ci_threshold", gate, F.lit(0)), check(health, "analysis_health", sick, F.lit(0)), check(counted(scope_issues), "scope", some, F.col("n")), check(counted(unrooted), "load_roots", some, F.col("n"))]
    return reduce(DataFrame.unionByName, parts)


def removal_plan(candidates: DataFrame, health: str, unrooted: bool) -> DataFrame:
    """(definition_id, obligation, status, required_action): six proofs for each candidate (definition_id, n_blockers, visibility)."""
    free, public = F.col("n_blockers") == 0, F.coalesce(F.col("visibility").isin("public", "protected"), F.lit(False))
    statuses = {
        "source": F.lit("complete" if health == "complete" else "partial"),
        "load": F.lit("partial" if unrooted else "complete"),
        "dispatch": F.when(free, "complete").otherwise("partial"),
        "framework": F.when(free, "complete").otherwise("partial"),
        "external_contract": F.when(public, "review").otherwise("complete"),
        "dynamic_evidence": F.lit("positive_only"),
    }
    rows = candidates.select("definition_id", F.explode(F.array(*[F.struct(F.lit(p).alias("obligation"), statuses[p].alias("status")) for p in PROOFS])).alias("p")).select("definition_id", "p.*")
    rare = F.when(F.col("obligation") == "dynamic_evidence", "observations are positive only: review rare paths")
    return rows.withColumn("required_action", F.when(F.col("status") == "complete", "none").otherwise(F.coalesce(rare, F.concat(F.lit("resolve or review: "), "obligation"))))


def feedback_verdict(missing: DataFrame, fail_on_missing: bool) -> DataFrame:
    """(passed, n_missing) of observed targets that the static graph lacks."""
    n = F.count(F.lit(1))
    return missing.agg((F.lit(not fail_on_missing) | (n == 0)).alias("passed"), n.alias("n_missing"))
