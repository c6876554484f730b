"""Guardrails: baselines, cascades and differences between two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import dealt


def new_findings(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that the baseline does not have (null keys are equal to null)."""
    left, right = current.alias("c"), baseline.select(*keys).distinct().alias("b")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return left.join(right, on, "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(key, before_state, after_state, change): full outer comparison; change is added, removed, changed or same."""
    b = before.select(F.col(key), F.col(state).alias("before_state"))
    a = after.select(F.col(key), F.col(state).alias("after_state"))
    change = F.when(F.col("before_state").isNull(), "added").when(F.col("after_state").isNull(), "removed").when(F.col("before_state") != F.col("after_state"), "changed").otherwise("same")
    return b.join(a, key, "full").withColumn("change", change)


def touched(findings: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Findings in changed files only."""
    return findings.join(changed.select(key).distinct(), key, "left_semi")


def feedback(static: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): observed pairs without static evidence (missing_static) and the reverse (unobserved).

    Both sides meet in one aggregate after one shuffle, which keeps a pair's two marks only. Null keys are equal."""
    side = lambda df, seen: df.select(*keys, F.lit(seen).alias("_seen"))
    met = dealt(side(static, False).unionByName(side(observed, True)), *keys).groupBy(*keys).agg(F.min("_seen").alias("_low"), F.max("_seen").alias("_high"))
    return met.filter("_low = _high").select(*keys, F.when(F.col("_high"), "missing_static").otherwise("unobserved").alias("kind"))


def claims(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(idx, outcome, finding): each baseline row claims the one current finding with its keys.

    ``baseline`` (idx, keys), ``current`` (finding, keys). outcome: matched, taken (an earlier row has the finding),
    ambiguous (several findings) or missing. Null keys match nothing. Findings are counted before the join, so a key that
    many findings share moves one row.
    """
    found = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("finding").alias("_finding"))
    first = baseline.groupBy(*keys).agg(F.min("idx").alias("_first"))
    joined = baseline.join(found.join(first, keys), keys, "left")
    outcome = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("idx") == F.col("_first"), "matched").otherwise("taken")
    return joined.select("idx", outcome.alias("outcome"), F.when(F.col("_n") == 1, F.col("_finding")).alias("finding"))


def surface_changes(before: DataFrame, after: DataFrame, key: str, visibility: str) -> DataFrame:
    """Public definitions that were added, removed or changed their visibility; equal ones are left out."""
    changed = changes(before, after, key, visibility).filter("change <> 'same'")
    public = (F.col("before_state") == "public") | (F.col("after_state") == "public")
    return changed.filter(F.coalesce(public, F.lit(False))).withColumn("change", F.when(F.col("change") == "changed", "visibility_changed").otherwise(F.col("change")))


CANDIDATES = ("review_candidate", "verified_candidate")


def is_candidate() -> Column:
    """Whether a finding could be removed: by its actionability, and where that is missing by class and blockers."""
    by_class = F.col("classification").isin("unreachable", "unused") & (F.coalesce("n_blockers", F.lit(0)) == 0)
    return F.coalesce(F.when(F.coalesce("actionability", F.lit("")) != "", F.col("actionability").isin(*CANDIDATES)).otherwise(by_class), F.lit(False))


def comparability(base: DataFrame, head: DataFrame) -> DataFrame:
    """(comparable, reasons) of two one-row reports (root, configuration_sha256): both must be there and equal."""
    pair = base.select(F.col("root").alias("_br"), F.col("configuration_sha256").alias("_bc")).crossJoin(head.select("root", "configuration_sha256"))

    def reason(a: str, b: str, name: str) -> Column:
        missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
        return F.when(missing, f"{name}_missing").when(F.col(a) != F.col(b), f"{name}_mismatch")

    reasons = F.array_compact(F.array(reason("_br", "root", "root"), reason("_bc", "configuration_sha256", "configuration")))
    return pair.select((F.size(reasons) == 0).alias("comparable"), reasons.alias("reasons"))


def causal_diff(base: DataFrame, head: DataFrame, witnessed: DataFrame, comparable: bool = True, complete: bool = True) -> DataFrame:
    """(definition_id, change): newly_unreachable, newly_reachable, newly_blocked and blocker_removed, in one full join.

    Findings (definition_id, classification, actionability, n_blockers), one for a definition. ``witnessed`` (definition_id):
    what the head's roots reach. The first two changes are only named for comparable reports and a complete head analysis.
    """
    side = lambda df, tag: df.select("definition_id", is_candidate().alias(f"_{tag}"), (F.coalesce("classification", F.lit("")) == "blocked").alias(f"_{tag}_blocked"), F.lit(True).alias(f"_in_{tag}"))
    both = side(base, "b").join(side(head, "h"), "definition_id", "full").join(witnessed.select("definition_id", F.lit(True).alias("_seen")).distinct(), "definition_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    sure = F.lit(comparable and complete)
    named = [
        F.when(sure & yes("_h") & ~yes("_b"), "newly_unreachable"),
        F.when(sure & yes("_b") & ~yes("_in_h") & yes("_seen"), "newly_reachable"),
        F.when(yes("_h_blocked") & ~yes("_b_blocked"), "newly_blocked"),
        F.when(yes("_b_blocked") & ~yes("_h_blocked"), "blocker_removed"),
    ]
    return both.select("definition_id", F.explode(F.array_compact(F.array(*named))).alias("change"))


def dispatch_became_partial(base: DataFrame, head: DataFrame) -> DataFrame:
    """(call_site_id, from, to): sites that were complete and no longer are. Rows (call_site_id, status, seq): the last one counts."""
    last = lambda df: df.groupBy("call_site_id").agg(F.max_by("status", "seq").alias("status"))
    joined = last(base).filter("status = 'complete'").select("call_site_id", F.col("status").alias("from")).join(last(head).filter("status in ('partial', 'unknown')"), "call_site_id")
    return joined.select("call_site_id", "from", F.col("status").alias("to"))


def removed_edges(base: DataFrame, head: DataFrame, targets: DataFrame) -> DataFrame:
    """(definition_id, n_base, n_head, n_removed): incoming edges (caller_id, callee_id, call_site_id) of targets before and after.

    Edges of both sides are told apart null-safely and counted once.
    """
    keys = ["caller_id", "callee_id", "call_site_id"]
    sides = base.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_h")).unionByName(head.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_h")))
    edges = sides.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_h").alias("_h"))
    counted = edges.groupBy(F.col("callee_id").alias("definition_id")).agg(F.sum("_b").alias("n_base"), F.sum("_h").alias("n_head"), F.sum(F.col("_b") * (1 - F.col("_h"))).alias("n_removed"))
    zero = F.lit(0).cast("long")
    return targets.select("definition_id").distinct().join(counted, "definition_id", "left").select("definition_id", *[F.coalesce(c, zero).alias(c) for c in ("n_base", "n_head", "n_removed")])


def baseline_cascade(entries: DataFrame, current: DataFrame) -> DataFrame:
    """(idx, strategy, n_candidates, finding): which current finding a baseline entry means, by the first rule that finds any.

    ``entries`` (idx, definition_id, fingerprint, body_digest, symbol_id, path, classification), ``current`` (finding,
    definition_id, physical_fingerprint, body_digest, symbol_id, path, classification). exact: definition id or fingerprint;
    body_digest: equal body, symbol and path; symbol_path_hint: equal symbol and path; the classification is the same in
    all. finding is the one candidate, NULL if there are several (a review) or none (unmatched). Findings are counted by key
    before the join, so that a place with many findings and many entries forms no pairs.
    """
    known = current.withColumn("_place", F.when(F.col("symbol_id").isNotNull() & F.col("path").isNotNull(), F.struct("symbol_id", "path")))
    asked = entries.withColumn("_place", F.when(F.col("symbol_id").isNotNull() & F.col("path").isNotNull(), F.struct("symbol_id", "path"))).withColumn("_print", F.coalesce("definition_id", "fingerprint"))
    rules = {  # by column of the findings: the entries' column
        "id": {"definition_id": "definition_id"},
        "print": {"physical_fingerprint": "_print"},
        "both": {"definition_id": "definition_id", "physical_fingerprint": "_print"},
        "body": {"body_digest": "body_digest", "_place": "_place"},
        "hint": {"_place": "_place"},
    }
    for name, keys in rules.items():
        counted = known.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("classification").alias("_kind")).agg(F.count_distinct("finding").alias(f"_n_{name}"), F.min("finding").alias(f"_f_{name}"))
        on = F.col("classification") == F.col("_kind")
        for i, c in enumerate(keys.values()):
            on = on & (F.col(c) == F.col(f"_k{i}"))
        asked = asked.join(counted, on, "left").drop("_kind", *[f"_k{i}" for i in range(len(keys))])
    n = lambda name: F.coalesce(F.col(f"_n_{name}"), F.lit(0).cast("long"))
    exact = n("id") + n("print") - n("both")
    told = F.when(exact > 0, F.struct(F.lit("exact").alias("strategy"), exact.alias("n"), F.least("_f_id", "_f_print").alias("finding")))
    for name, strategy in (("body", "body_digest"), ("hint", "symbol_path_hint")):
        told = told.when(n(name) > 0, F.struct(F.lit(strategy).alias("strategy"), n(name).alias("n"), F.col(f"_f_{name}").alias("finding")))
    joined = asked.select("idx", told.alias("_m"))
    return joined.select("idx", F.coalesce("_m.strategy", F.lit("unmatched")).alias("strategy"), F.coalesce("_m.n", F.lit(0).cast("long")).alias("n_candidates"), F.when(F.col("_m.n") == 1, F.col("_m.finding")).alias("finding"))


def ci_check(current: DataFrame, baseline: DataFrame, health: str, allowed: list[str], codes: list[str], changed: DataFrame | None = None) -> DataFrame:
    """(check, passed, n): analysis health, counts beside the baseline by confidence, and new candidates.

    ``current`` and ``baseline`` (physical_fingerprint, file, confidence, and for current is_candidate). A degraded analysis passes
    only if all its codes are allowed. ``changed`` (file) limits new candidates to changed files.
    """
    spark = current.sparkSession
    open_codes = sorted(set(codes) - set(allowed))
    fine = health == "complete" or (health == "degraded" and bool(codes) and not open_codes)
    first = spark.createDataFrame([("analysis_health", fine, len(open_codes) if health != "invalid" else len(codes))], "check string, passed boolean, n long")
    now = current.filter("is_candidate")
    counts = now.groupBy().agg(F.count(F.lit(1)).alias("a")).crossJoin(baseline.groupBy().agg(F.count(F.lit(1)).alias("b")))
    ratchet = counts.select(F.lit("ratchet").alias("check"), (F.col("a") <= F.col("b")).alias("passed"), (F.col("a") - F.col("b")).alias("n"))
    fresh = now.join(baseline.select("physical_fingerprint"), "physical_fingerprint", "left_anti")
    fresh = fresh if changed is None else touched(fresh, changed, "file")
    new = fresh.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("new_candidates").alias("check"), (F.col("n") == 0).alias("passed"), "n")
    return first.unionByName(ratchet).unionByName(new)
