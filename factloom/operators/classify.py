"""Classification and scoring of findings: ordered CASE expressions over joined flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import confidence_level

#: Fixed base scores by classification.
BASE = {"blocked": 0.25, "unreachable": 0.62, "test_only_reachable": 0.55, "unused": 0.58}
#: Fixed penalties by flag, with the names of their score components.
PENALTIES = {"is_uncertain": ("near_metaprogramming", 0.35), "is_dynamic_owner": ("dynamic_owner", 0.25), "is_generated_accessor": ("generated_accessor", 0.2), "is_implicit": ("implicit_caller", 0.4)}
#: Fixed blocker kinds that make an analysis invalid or degraded.
INVALID_KINDS = ("analyzer_failure", "blocker_invalid", "evidence_collision", "rails_route_health", "resolution_invalid", "unsound_rta_pruning")
DEGRADED_KINDS = ("reference_scan_incomplete", "reference_scope_incomplete", "source_discovery_incomplete")


def classification() -> Column:
    """Alive, runtime and external reach come first, then blockers, then test reach."""
    return (
        F.when(F.col("alive") | F.col("runtime") | F.col("external"), F.lit(None).cast("string"))
        .when(F.col("n_blockers") > 0, "blocked")
        .when(F.col("test"), "test_only_reachable")
        .otherwise("unreachable")
    )


def components(kind: Column) -> Column:
    """Score components in order (name, value): the base, the penalties that apply, notes of 0.0 and the clamp.

    Runtime observation only adds a note (``is_unobserved``): not to be observed never lowers a score.
    """
    none = F.lit(None).cast("struct<name:string,value:double>")
    part = lambda name, value: F.struct(name.alias("name"), F.round(value.cast("double"), 4).alias("value"))
    base = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BASE.items()])
    listed = [part(F.concat(F.lit("base("), kind, F.lit(")")), base), F.when(F.col("n_blockers") > 0, part(F.lit("matching_blocker"), F.lit(0.0))).otherwise(none)]
    listed += [F.when(F.col(flag), part(F.lit(name), F.lit(-value))).otherwise(none) for flag, (name, value) in PENALTIES.items()]
    listed.append(F.when(F.col("is_unobserved"), part(F.lit("runtime_unobserved"), F.lit(0.0))).otherwise(none))
    raw = _total(kind)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    listed.append(F.when(clamped != raw, part(F.lit("score_clamp"), clamped - raw)).otherwise(none))
    return F.array_compact(F.array(*listed))


def _total(kind: Column) -> Column:
    total = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BASE.items()])
    for flag, (_, penalty) in PENALTIES.items():
        total = total - F.when(F.col(flag), F.lit(penalty)).otherwise(F.lit(0.0))
    return total


def score(kind: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _total(kind))), 4)


def reachability_state() -> Column:
    """A node's state: blockers first, then outside, runtime, test and observed reach; ``classification`` decides the rest."""
    return (
        F.when(F.col("n_blockers") > 0, "unknown")
        .when(F.col("external"), "externally_reachable")
        .when(F.col("runtime") | F.col("test"), "statically_reachable")
        .when(F.col("alive"), "observed_alive")
        .when(F.col("classification").isin("unreachable", "unused"), "unreachable_under_model")
        .otherwise("unknown")
    )


def severity(kind: Column) -> Column:
    """invalid, degraded or NULL by blocker kind."""
    return F.when(kind.isin(*INVALID_KINDS), "invalid").when(kind.isin(*DEGRADED_KINDS), "degraded")


def actionability(kind: Column) -> Column:
    return F.when(kind.isin("unreachable", "unused"), "review_candidate").otherwise("diagnostic")


def findings(nodes: DataFrame) -> DataFrame:
    """Findings of nodes with flags alive, runtime, external, test, n_blockers and the penalty flags (missing ones: false).

    Nodes with ``is_test``, outside the ``domain`` analyze or with a ``defined_via`` that a framework generates are no findings.
    """
    if "is_test" in nodes.columns:
        nodes = nodes.filter(~F.coalesce("is_test", F.lit(False)))
    if "domain" in nodes.columns:
        nodes = nodes.filter("domain = 'analyze'")
    if "defined_via" in nodes.columns:
        nodes = nodes.filter(~F.coalesce(F.col("defined_via").startswith("rails_"), F.lit(False)))
    for flag in [*PENALTIES, "is_unobserved"]:
        if flag not in nodes.columns:
            nodes = nodes.withColumn(flag, F.lit(False))
    rows = nodes.withColumn("classification", classification()).filter("classification is not null")
    rows = rows.withColumn("score", score(F.col("classification"))).withColumn("components", components(F.col("classification"))).withColumn("state", reachability_state())
    return rows.withColumn("confidence", confidence_level(F.col("score"))).withColumn("actionability", actionability(F.col("classification")))


def flag_nodes(nodes: DataFrame, reached: DataFrame, blocked: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """nodes (node) with reach flags by domain and blocker counts, from reach() and (node) rows of blockers.

    ``observed`` (node): what ran; those nodes are alive, and all others get the flag is_unobserved.
    """
    flags = reached.groupBy("node").agg(*[F.max(F.col("domain") == d).alias(d) for d in ("runtime", "test", "external")])
    counts = blocked.groupBy("node").agg(F.count(F.lit(1)).alias("n_blockers"))
    joined = nodes.join(flags, "node", "left").join(counts, "node", "left")
    alive, unobserved = F.lit(False), F.lit(False)
    if observed is not None:
        joined = joined.join(observed.select("node", F.lit(True).alias("_ran")).distinct(), "node", "left")
        alive, unobserved = F.coalesce("_ran", F.lit(False)), F.col("_ran").isNull()
    reach = [F.coalesce(d, F.lit(False)).alias(d) for d in ("runtime", "test", "external")]
    return joined.select(*nodes.columns, *reach, F.coalesce("n_blockers", F.lit(0)).alias("n_blockers"), alive.alias("alive"), unobserved.alias("is_unobserved"))


def health(severities: DataFrame) -> DataFrame:
    """One row: invalid if any row is, else degraded if any is, else complete."""
    worst = F.max(F.when(F.col("severity") == "invalid", 2).when(F.col("severity") == "degraded", 1).otherwise(0))
    return severities.agg(F.element_at(F.array(F.lit("complete"), F.lit("degraded"), F.lit("invalid")), F.coalesce(worst, F.lit(0)) + 1).alias("status"), F.count(F.lit(1)).alias("n_reasons"))
