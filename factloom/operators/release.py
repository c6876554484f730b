"""Release audit: two reports of several corpora compared, new strong candidates with their labels, reviews owed, and gates.

Findings are (corpus, definition_id, id, state, confidence, actionability, candidate). A finding is named by its definition id,
else by its logical id; a name that a report gives twice in a corpus is an error of the report (see ``repeated_names``).
Labels and reviews meet a finding by the definition id first and by the logical id only where that finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.sampling import top_per_key

# States, levels and labels as reports and reviewers write them.
CANDIDATE_STATES = ("unreachable", "unused", "candidate")
HIGH = ("high", "certain")
REVIEWABLE = ("verified_candidate", "review_candidate")
LABELS = ("dead", "alive", "external", "unknown")
FALSE_POSITIVES = ("alive", "external")
OUTCOMES = ("expected_safety_change", "false_positive", "true_positive")

CHANGES = {"state_changed": "state", "confidence_changed": "confidence", "actionability_changed": "actionability"}
REVIEWED_CHANGES = ("added", "removed", "state_changed")


def _identity() -> Column:
    return F.coalesce("definition_id", "id")


def repeated_names(findings: DataFrame) -> DataFrame:
    """(corpus, identity, n): names that one report gives to several findings."""
    return findings.groupBy("corpus", _identity().alias("identity")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reviewable() -> Column:
    """Whether a finding belongs in the review queue: its actionability decides where it has one, else candidate or state."""
    otherwise = F.coalesce("candidate", F.lit(False)) | F.coalesce(F.col("state").isin(*CANDIDATE_STATES), F.lit(False))
    return F.when(F.col("actionability").isNotNull(), F.col("actionability").isin(*REVIEWABLE)).otherwise(otherwise)


def review_class() -> Column:
    """A queued finding's class: its actionability if that is reviewable, else by confidence."""
    high = F.coalesce(F.col("confidence").isin(*HIGH), F.lit(False))
    return F.when(F.col("actionability").isin(*REVIEWABLE), F.col("actionability")).when(high, "high_candidate").otherwise("candidate")


def high_actionable() -> Column:
    """A strong candidate: high or certain, and a candidate as stated, else by its state."""
    by_state = F.col("state").isin(*CANDIDATE_STATES)
    return F.coalesce(F.col("confidence").isin(*HIGH), F.lit(False)) & F.coalesce("candidate", by_state, F.lit(False))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(corpus, change, identity, definition_id, id, before_state, after_state): what changed, one row for each kind of change.

    One full join by (corpus, identity) serves the five kinds; ids are those of the later report where it has the finding.
    """
    side = lambda rows: rows.select("corpus", _identity().alias("identity"), F.struct("definition_id", "id", "state", "confidence", "actionability").alias("f"))
    b, a = side(before).withColumnRenamed("f", "b"), side(after).withColumnRenamed("f", "a")
    both = b.join(a, ["corpus", "identity"], "full")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = [F.when(F.col("b").isNull(), "added"), F.when(F.col("a").isNull(), "removed")]
    kinds += [F.when(common & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), name) for name, c in CHANGES.items()]
    told = both.select("corpus", F.explode(F.array_compact(F.array(*kinds))).alias("change"), "identity", "a", "b")
    found = lambda c: F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return told.select("corpus", "change", "identity", found("definition_id"), found("id"), F.col("b.state").alias("before_state"), F.col("a.state").alias("after_state"))


def by_precedence(rows: DataFrame, told: DataFrame, key: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` and match (physical, logical or NULL): what ``told`` says of a row's definition id, else of its id.

    ``told`` (key, target, value): target is a definition id or a logical id; one row a target.
    """
    physical = told.select(*key, F.col("target").alias("definition_id"), F.struct(F.col(value).alias("v")).alias("_p"))
    logical = told.select(*key, F.col("target").alias("id"), F.struct(F.col(value).alias("v")).alias("_l"))
    joined = rows.join(physical, [*key, "definition_id"], "left").join(logical, [*key, "id"], "left")
    match = F.when(F.col("_p").isNotNull(), "physical").when(F.col("_l").isNotNull(), "logical")
    return joined.select(*[joined[c] for c in rows.columns], F.coalesce("_p", "_l")["v"].alias(value), match.alias("match"))


def newly_high(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """(corpus, identity, definition_id, id, label, match): strong candidates that the earlier report did not have as such.

    ``labels`` (corpus, target, label), label a struct (value, rationale, reviewer). An anti join on the earlier strong
    candidates; only what is left meets the labels.
    """
    strong = lambda rows: rows.filter(high_actionable()).select("corpus", _identity().alias("identity"), "definition_id", "id")
    new = strong(after).join(strong(before).select("corpus", "identity").distinct(), ["corpus", "identity"], "left_anti")
    return by_precedence(new, labels, ["corpus"], "label")


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def valid_label() -> Column:
    """A label counts with a known value, a rationale and a reviewer."""
    return F.coalesce(F.col("label.value").isin(*LABELS), F.lit(False)) & _filled(F.col("label.rationale")) & _filled(F.col("label.reviewer"))


def valid_review() -> Column:
    """A review counts with a known outcome, a rationale and a reviewer."""
    return F.coalesce(F.col("review.outcome").isin(*OUTCOMES), F.lit(False)) & _filled(F.col("review.rationale")) & _filled(F.col("review.reviewer"))


def required_reviews(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """The changes that must be reviewed: all of a corpus, or the first ``minimum`` of each stratum by id.

    ``policies`` (corpus, minimum): NULL asks for all; a corpus without a row asks for none. A stratum is a kind of change
    with the states before and after. Spark keeps at most the largest ``minimum`` rows of a stratum in each task.
    """
    owed = changes.filter(F.col("change").isin(*REVIEWED_CHANGES)).join(policies, "corpus")
    everything = owed.filter("minimum is null")
    most = policies.agg(F.max("minimum")).first()[0] or 0
    strata, order = ["corpus", "change", "before_state", "after_state"], ["id", F.coalesce("definition_id", F.lit(""))]
    sampled = owed.filter("minimum is not null")
    if most:
        first = top_per_key(sampled, strata, order, int(most))
        from_one = first.groupBy(*strata, "minimum").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", F.coalesce("definition_id", F.lit("")).alias("d"), "identity", "definition_id"))), 1, F.col("minimum")).alias("_r"))
        sampled = from_one.select("corpus", "change", F.explode("_r").alias("r"), "before_state", "after_state").select("corpus", "change", "r.identity", "r.definition_id", "r.id", "before_state", "after_state")
    else:
        sampled = sampled.limit(0)
    return everything.select(changes.columns).unionByName(sampled.select(changes.columns))


def review_status(required: DataFrame, reviews: DataFrame) -> DataFrame:
    """``required`` with review, match and status: completed, invalid (supplied, not valid) or missing.

    ``reviews`` (corpus, change, target, review), review a struct (outcome, rationale, reviewer). An invalid one is owed still.
    """
    told = by_precedence(required, reviews, ["corpus", "change"], "review")
    return told.withColumn("status", F.when(valid_review(), "completed").when(F.col("review").isNotNull(), "invalid").otherwise("missing"))


def release_gates(new_high: DataFrame, reviewed: DataFrame, checks: DataFrame) -> DataFrame:
    """(gate, passed, failures) of a release; it passes if all rows do.

    ``new_high`` and ``reviewed`` are results of ``newly_high`` and ``review_status``; ``checks`` (gate, passed) are results from elsewhere, one
    row a corpus or suite: performance, adversarial, precision_quality, public_claim. A NULL is a failure. Performance and
    adversarial gates stand (and pass) without rows; the last two are left out where they aren't enforced.
    """
    value = F.col("label.value")
    counts = new_high.agg(
        F.count_if(~valid_label()).alias("new_high_reviewed"),
        F.count_if(value.isin(*FALSE_POSITIVES)).alias("new_high_false_positives"),
        F.count_if(value == "unknown").alias("new_high_unresolved"),
    ).unpivot([], ["new_high_reviewed", "new_high_false_positives", "new_high_unresolved"], "gate", "failures")
    seen = reviewed.agg(
        F.count_if(F.col("status") != "completed").alias("difference_review"),
        F.count_if((F.col("status") == "completed") & (F.col("review.outcome") == "false_positive")).alias("review_false_positives"),
    ).unpivot([], ["difference_review", "review_false_positives"], "gate", "failures")
    always = checks.sparkSession.createDataFrame([("performance",), ("adversarial",)], "gate string").select("gate", F.lit(True).alias("passed"))
    others = checks.select("gate", "passed").unionByName(always).groupBy("gate").agg(F.count_if(~F.coalesce("passed", F.lit(False))).alias("failures"))
    return counts.unionByName(seen).unionByName(others).select("gate", (F.col("failures") == 0).alias("passed"), "failures")


def release_criteria(measured: DataFrame, precision: float, recall: float | None = None) -> DataFrame:
    """``measured`` (candidate_precision, candidate_count, known_positive_recall, ...) with checks and passed.

    Precision at its threshold or above, at least one candidate, and, only if a threshold is given, recall; NULL fails.
    """
    held = {"precision": F.col("candidate_precision") >= precision, "candidate_yield": F.col("candidate_count") > 0}
    if recall is not None:
        held["recall"] = F.col("known_positive_recall") >= recall
    held = {name: F.coalesce(c, F.lit(False)) for name, c in held.items()}
    every = F.lit(True)
    for c in held.values():
        every = every & c
    return measured.withColumn("checks", F.struct(*[c.alias(name) for name, c in held.items()])).withColumn("passed", every)
