"""Evaluation of reports: quality, categories, candidates of several tools, ablations and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import loc, metric_delta, nullable_ratio, ratio

ORDINARY = ("def", "defs", "define_method")


def category() -> Column:
    """A finding's category: the stated one, the first blocker kind, generated_method, or its classification."""
    return F.coalesce("category", F.get("blocker_kinds", F.lit(0)), F.when(~F.col("defined_via").isin(*ORDINARY), "generated_method"), "classification")


def risk_flags() -> Column:
    """Sorted risk flags of a finding (visibility, defined_via, owner, test, blocker_kinds)."""
    n = F.coalesce(F.size("blocker_kinds"), F.lit(0))
    flags = {
        "analysis_incomplete": n > 0,
        "duplicate_or_redefinition": F.coalesce(F.array_contains("blocker_kinds", "duplicate_definition"), F.lit(False)),
        "generated_method": ~F.col("defined_via").isin(*ORDINARY),
        "no_owner": F.coalesce("owner", F.lit("")) == "",
        "public_or_protected_visibility": F.col("visibility").isin("public", "protected"),
        "test_definition": F.coalesce("test", F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in flags.items()]))


def tally(rows: DataFrame, values: str, name: str = "value") -> DataFrame:
    """(value, n) of an array column's elements."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def quality(findings: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of findings, by group: candidates, their lines, precision on ``gold`` ids, blocked and unknown ones.

    ``findings`` (definition_id, symbol_id, is_candidate, classification, is_unknown, line, end_line, by), ``gold`` (id, by).
    A candidate counts as right if its definition or symbol id is in gold (of its group). Precision is NULL without candidates
    or gold rows, recall without gold rows.
    """
    by = by or []
    ids = gold.select(*by, "id").distinct()
    tagged = findings.select("*", F.explode(F.array_distinct(F.array("definition_id", "symbol_id"))).alias("id"))
    right = tagged.filter("is_candidate").join(ids, [*by, "id"]).select(*by, "definition_id", "id")
    hits = right.groupBy(*by).agg(F.count_distinct("definition_id").alias("_right"), F.count_distinct("id").alias("_found"))
    size = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("known_positive_count"))
    candidate = F.col("is_candidate")
    sums = findings.groupBy(*by).agg(
        F.count_if(candidate).alias("candidate_count"),
        F.coalesce(F.sum(F.when(candidate, loc(F.col("line"), F.col("end_line")))), F.lit(0)).cast("long").alias("candidate_loc"),
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(~candidate).alias("diagnostic_count"),
        F.count_if(F.col("classification") == "blocked").alias("blocked_count"),
        F.count_if(F.col("is_unknown")).alias("unknown_count"),
    )
    if by:
        spine = sums.select(*by).union(size.select(*by)).distinct()
        out = spine.join(sums, by, "left").join(hits, by, "left").join(size, by, "left")
    else:
        out = sums.crossJoin(hits).crossJoin(size)
    numbers = [c for c in sums.columns if c not in by] + ["_right", "_found", "known_positive_count"]
    out = out.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    known = F.col("known_positive_count") > 0
    return out.select(
        *by, *[c for c in sums.columns if c not in by], "known_positive_count",
        F.when(known, nullable_ratio(F.col("_right"), F.col("candidate_count"))).alias("candidate_precision"),
        F.when(known, nullable_ratio(F.col("_found"), F.col("known_positive_count"))).alias("known_positive_recall"),
        ratio(F.col("blocked_count"), F.col("finding_count")).alias("blocked_rate"), ratio(F.col("unknown_count"), F.col("finding_count")).alias("unknown_rate"),
    )


def resolution_counts(resolutions: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(total, complete, partial, unknown) of call sites' states, of those in visible files only if such (file) are given."""
    rows = resolutions if visible is None else resolutions.join(visible.select("file").distinct(), "file", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "unknown")])


def ablation(on: DataFrame, off: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """(key, measure, delta): each measure with a feature less without it; NULL where either is missing."""
    long = lambda rows, name: rows.select(*key, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(key, measures, "measure", name)
    joined = long(on, "_on").join(long(off, "_off"), [*key, "measure"], "full")
    return joined.select(*key, "measure", metric_delta(F.col("_on"), F.col("_off")).alias("delta"))


def only_in(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): the symmetric difference of two sets of rows, with the side that has it."""
    a, b = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")), right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    both = a.unionByName(b).groupBy(*key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.filter("_l + _r = 1").select(*key, F.when(F.col("_l") == 1, "left").otherwise("right").alias("side"))


def candidate_union(candidates: DataFrame, tools: list[str]) -> DataFrame:
    """(corpus, identity, tools...): which tool names which candidate; rows that no tool calls a candidate are left out.

    ``candidates`` (corpus, definition_id, id, tool, candidate). A row is named by its definition id, else by its logical id.
    """
    rows = candidates.select("corpus", F.coalesce("definition_id", "id").alias("identity"), "tool", F.coalesce("candidate", F.lit(False)).alias("candidate"))
    wide = rows.groupBy("corpus", "identity").agg(*[F.coalesce(F.max(F.when(F.col("tool") == t, F.col("candidate"))), F.lit(False)).alias(t) for t in tools])
    some = F.lit(False)
    for t in tools:
        some = some | F.col(t)
    return wide.filter(some)


def recalled(known: DataFrame, selected: DataFrame) -> DataFrame:
    """``known`` (corpus, definition_id, id) with recalled: matched by definition id where it has one, else by logical id."""
    exact = selected.select("corpus", "definition_id", F.lit(True).alias("_d")).filter("definition_id is not null").distinct()
    logical = selected.select("corpus", "id", F.lit(True).alias("_i")).filter("id is not null").distinct()
    joined = known.join(exact, ["corpus", "definition_id"], "left").join(logical, ["corpus", "id"], "left")
    return joined.withColumn("recalled", F.when(F.col("definition_id").isNotNull(), F.col("_d").isNotNull()).otherwise(F.col("_i").isNotNull())).select(*known.columns, "recalled")


def attach_labels(candidates: DataFrame, labels: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates with value, faults): labels by key; faults (key, fault) are labels without a candidate or given twice."""
    counted = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("value"))
    faults = counted.join(candidates.select(*key).distinct(), key, "left_anti").select(*key, F.lit("unmatched").alias("fault"))
    faults = faults.unionByName(counted.filter("_n > 1").select(*key, F.lit("repeated").alias("fault")))
    return candidates.join(counted.drop("_n"), key, "left"), faults


def sites_of_definitions(targets: DataFrame, rejected: DataFrame) -> DataFrame:
    """(definition_id, n_sites, sites): the distinct call sites that resolve to or reject each definition."""
    rows = targets.select("definition_id", "site").unionByName(rejected.select("definition_id", "site")).distinct()
    return rows.groupBy("definition_id").agg(F.count(F.lit(1)).alias("n_sites"), F.sort_array(F.collect_list("site")).alias("sites"))


def gate(checks: DataFrame) -> DataFrame:
    """(passed, n_checks, failed): whether all checks (check, passed) hold; a NULL does not. No check, no pass."""
    held = F.coalesce("passed", F.lit(False))
    return checks.agg((F.coalesce(F.bool_and(held), F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("n_checks"), F.sort_array(F.collect_set(F.when(~held, F.col("check")))).alias("failed"))


def precision_gate(measured: DataFrame, precision: float, yield_: int, recall: float | None = None) -> DataFrame:
    """(check, passed) of one row of ``quality``: least precision, least number of candidates and, if given, least recall."""
    wanted = [("candidate_precision", precision), ("candidate_count", yield_)] + ([("known_positive_recall", recall)] if recall is not None else [])
    checks = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c) >= v, F.lit(False)).alias("passed")) for c, v in wanted])
    return measured.select(F.explode(checks).alias("_c")).select("_c.*")


DETERMINATE = ("dead", "alive", "external")


def candidate_metrics(selected: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision and recall of selected candidates by corpus, category or tool.

    ``selected`` (candidate, label, loc, confidence, by), ``known`` (candidate, by): known positives. Only dead, alive and
    external labels are reviewed; precision is NULL where none is, recall where nothing is known. A group that only one of
    the two has stays.
    """
    reviewed = F.col("label").isin(*DETERMINATE)
    sums = selected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.coalesce(F.sum("loc"), F.lit(0)).alias("candidate_loc"), F.count("loc").alias("loc_measured_count"), F.count_if(reviewed).alias("reviewed_count"),
        F.count_if(reviewed & F.col("confidence").isin("certain", "high")).alias("reviewed_high_count"), F.count_if(F.col("label") == "dead").alias("_right"),
    )
    mine = selected.select(*by, "candidate", F.lit(True).alias("_hit")).distinct()
    found = known.select(*by, "candidate").distinct().join(mine, [*by, "candidate"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("known_positive_count"), F.count("_hit").alias("_found"))
    numbers = [c for c in sums.columns + found.columns if c not in by]
    out = sums.join(found, by, "full").select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers])
    precision = nullable_ratio(F.col("_right"), F.col("reviewed_count")).alias("candidate_precision")
    recall = nullable_ratio(F.col("_found"), F.col("known_positive_count")).alias("known_positive_recall")
    return out.select(*by, *[c for c in numbers if not c.startswith("_")], precision, recall)


def aggregate_quality(parts: DataFrame) -> DataFrame:
    """One row for several reports: sums, and the rates made anew from them. ``parts`` has the counts of ``quality`` and
    resolution_total, resolution_unknown."""
    names = ["candidate_count", "candidate_loc", "diagnostic_count", "blocked_count", "unknown_count", "resolution_total", "resolution_unknown"]
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    findings = F.col("candidate_count") + F.col("diagnostic_count")
    return sums.select(*names[:5], ratio(F.col("blocked_count"), findings).alias("blocked_rate"), ratio(F.col("unknown_count"), findings).alias("unknown_rate"), ratio(F.col("resolution_unknown"), F.col("resolution_total")).alias("unknown_resolution_rate"))


def merged_tallies(parts: DataFrame, counts: str) -> DataFrame:
    """(value, n): maps from values to counts, of many rows, added up."""
    return parts.select(F.explode(counts).alias("value", "n")).groupBy("value").agg(F.sum("n").alias("n"))


def phase_rollup(phases: DataFrame) -> DataFrame:
    """(name, seconds, allocated, peak_rss_kb) by phase; a phase that ran often is one row, the memory its highest."""
    return phases.groupBy("name").agg(F.sum("seconds").alias("seconds"), F.sum("allocated").alias("allocated"), F.max("rss_kb").alias("peak_rss_kb"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys that should be unique and are not."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unambiguous(facts: DataFrame, name: str, fact: str) -> DataFrame:
    """(name, fact) of names with one fact; a name with two different ones is dropped, a null fact is a fact."""
    seen = F.concat(F.lit("v"), F.col(fact).cast("string"))
    one = facts.groupBy(name).agg(F.count_distinct(F.coalesce(seen, F.lit("-"))).alias("_n"), F.first(fact).alias(fact))
    return one.filter("_n = 1").drop("_n")


def count_at_least(rows: DataFrame, level: Column, least: Column) -> DataFrame:
    """(n): rows whose level (a rank) is at least another; unknown levels don't count."""
    return rows.agg(F.count_if(level >= least).alias("n"))


def review_coverage(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """(corpus, changes, required, completed, zero_difference): every corpus of ``policies`` has a row.

    ``changes`` (corpus, required, reviewed).
    """
    counted = changes.groupBy("corpus").agg(F.count(F.lit(1)).alias("changes"), F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("reviewed")).alias("completed"))
    out = policies.select("corpus").distinct().join(counted, "corpus", "left").fillna(0, ["changes", "required", "completed"])
    return out.withColumn("zero_difference", F.col("changes") == 0)


def queue_summary(corpora: DataFrame, available: DataFrame, queued: DataFrame) -> DataFrame:
    """(corpus, available, queued, queued_high): every corpus has a row. ``queued`` (corpus, confidence)."""
    there = available.groupBy("corpus").agg(F.count(F.lit(1)).alias("available"))
    taken = queued.groupBy("corpus").agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("confidence").isin("certain", "high")).alias("queued_high"))
    return corpora.select("corpus").distinct().join(there, "corpus", "left").join(taken, "corpus", "left").fillna(0)


def safety_violations(base: DataFrame, mutant: DataFrame) -> DataFrame:
    """(definition_id, violation): candidates that a mutation added, and candidates that are blocked as well.

    Both (definition_id, is_candidate, is_blocked).
    """
    mine = mutant.filter("is_candidate").select("definition_id")
    added = mine.subtract(base.filter("is_candidate").select("definition_id")).withColumn("violation", F.lit("added_candidate"))
    both = mine.intersect(mutant.filter("is_blocked").select("definition_id")).withColumn("violation", F.lit("blocked_candidate"))
    return added.unionByName(both)


def instantiated_sample(classes: DataFrame, limit: int = 64, few: int = 16) -> DataFrame:
    """(n, sample, digest): all class names in order up to ``limit``, else the first ``few``; the digest covers every name."""
    names = classes.select("name").filter("name is not null").distinct()
    first = names.orderBy("name").limit(limit + 1).agg(F.array_sort(F.collect_list("name")).alias("_s"))
    whole = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("name").cast("decimal(38,0)")), F.lit(0)).alias("_a"), F.coalesce(F.sum(F.xxhash64(F.reverse("name"), F.lit(1)).cast("decimal(38,0)")), F.lit(0)).alias("_b"))
    sample = F.when(F.col("n") <= limit, F.col("_s")).otherwise(F.slice("_s", 1, few)).alias("sample")
    return whole.crossJoin(F.broadcast(first)).select("n", sample, F.sha2(F.concat_ws(",", "n", "_a", "_b"), 256).alias("digest"))
