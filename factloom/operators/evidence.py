"""The evidence store: identity, de-duplication, collision quarantine and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import dealt

ID = ["evidence_id"]


def identity(prefix: str, cols: list[str]) -> Column:
    """A SHA-256 name of the columns' values as a JSON array: no separator can be forged, and null is not the empty text."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in cols]), {"ignoreNullFields": "false"}), 256))


def with_payload(evidence: DataFrame, id_cols: list[str], payload: list[str]) -> DataFrame:
    """Adds evidence_id (from ``id_cols``) and payload_digest (from ``payload``)."""
    return evidence.withColumn("evidence_id", identity("evidence:v1", id_cols)).withColumn("payload_digest", identity("payload:v1", payload))


def by_columns(evidence: DataFrame, id_cols: list[str], payload: list[str]) -> DataFrame:
    """Rows dealt by the columns that make their id, with payload_digest: one shuffle of plain columns, for operators that are
    told ``by`` these columns. Ids and digests, which don't compress, are made after it."""
    return dealt(evidence, *id_cols).withColumn("payload_digest", identity("payload:v1", payload))


def collisions(evidence: DataFrame, by: list[str] = ID) -> DataFrame:
    """(evidence_id or what it is made ``by``, n_payloads): ids that were seen with two payloads or more."""
    return evidence.groupBy(*by).agg(F.count_distinct("payload_digest").alias("n_payloads")).filter("n_payloads > 1")


def collision_report(evidence: DataFrame, domain_col: str, limit: int = 50) -> DataFrame:
    """(evidence_id, n_payloads, payloads, domains): collided ids with their first ``limit`` digests and all their domains."""
    found = evidence.join(collisions(evidence), "evidence_id")
    return found.groupBy("evidence_id").agg(F.max("n_payloads").alias("n_payloads"), F.slice(F.sort_array(F.collect_set("payload_digest")), 1, limit).alias("payloads"), F.sort_array(F.collect_set(domain_col)).alias("domains"))


def accepted(evidence: DataFrame, by: list[str] = ID) -> DataFrame:
    """One row for each id with one payload; an id with two payloads is removed entirely, with all it supported.

    min and max of the digest tell one payload from two in one partial aggregate, without a distinct count's expansion.
    """
    carried = F.struct(*[c for c in evidence.columns if c not in by])
    once = evidence.groupBy(*by).agg(F.min("payload_digest").alias("_low"), F.max("payload_digest").alias("_high"), F.min(carried).alias("_row"))
    return once.filter("_low = _high").select(*by, "_row.*")


def collision_blockers(evidence: DataFrame, domain_col: str, by: list[str] = ID) -> DataFrame:
    """(domain, n_ids): each domain in which a collided id was registered gets one global blocker.

    An id's domains are made distinct before they are gathered; all three steps need one shuffle, by the id."""
    low, high, domains = F.min("payload_digest").alias("_low"), F.max("payload_digest").alias("_high"), F.collect_list("_d").alias("_domains")
    each = evidence.select(*by, F.struct(F.col(domain_col).alias("domain")).alias("_d"), "payload_digest").groupBy(*by, "_d").agg(low, high)
    bad = each.groupBy(*by).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), domains).filter("_low <> _high")
    return bad.select(F.explode("_domains").alias("_d")).groupBy("_d.domain").agg(F.count(F.lit(1)).alias("n_ids"))


def in_projection(projection: str, grade: Column, verified: Column) -> Column:
    """conservative: all; exact: exact or verified observed; observed: observed and verified."""
    if projection == "conservative":
        return F.lit(True)
    observed = (grade == "observed") & verified
    return observed if projection == "observed" else (grade == "exact") | observed


def conflicts(resolutions: DataFrame) -> DataFrame:
    """(site, n_sets): sites for which producers state different complete target sets. ``resolutions`` (site, producer, target)."""
    sets = resolutions.groupBy("site", "producer").agg(F.array_join(F.array_sort(F.collect_set(F.col("target").cast("string"))), ",").alias("targets"))
    return sets.groupBy("site").agg(F.count_distinct("targets").alias("n_sets")).filter("n_sets > 1")


def divergent(resolutions: DataFrame, producer: list[str], result: list[str]) -> DataFrame:
    """(producer, n_results): one producer's different results for one site and set of assumptions."""
    return resolutions.groupBy(*producer).agg(F.count_distinct(F.struct(*result)).alias("n_results")).filter("n_results > 1")


def relations(edges: DataFrame, evidence: DataFrame, projection: str) -> DataFrame:
    """(caller_id, callee_id, evidence_ids): edges with the sorted ids of their evidence in a projection; none, no edge.

    ``evidence`` (evidence_id, grade, verified).
    """
    kept = evidence.filter(in_projection(projection, F.col("grade"), F.col("verified"))).select("evidence_id")
    return edges.join(kept, "evidence_id").groupBy("caller_id", "callee_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))


def scope_matches(actual: Column, requested: Column) -> Column:
    """Whether a map of strings has every requested key with the same value; no request matches all."""
    return F.coalesce(F.forall(F.map_entries(requested), lambda kv: F.coalesce(F.element_at(actual, kv["key"]) == kv["value"], F.lit(False))), F.lit(True))


def observed_verified(actual: Column, requested: Column, status: Column) -> Column:
    """Whether observed evidence counts: a scope with a revision was asked for, it matches, and the revision isn't stale."""
    asked = F.coalesce(F.element_at(requested, "source_revision") != "", F.lit(False))
    return asked & scope_matches(actual, requested) & ~F.coalesce(status.isin("mismatch", "stale"), F.lit(False))
