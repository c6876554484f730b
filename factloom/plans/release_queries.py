"""Registered queries of the release audit, of adjacency and precedence of edges, and of macro and skip rollups; beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import adjacency, release
from factloom.plans.registry import query
from factloom.sources.tables import table

SPLIT = "1997-01-01"


def _report(spark, sf_dir, later: bool):
    """Each customer's orders before or after a day as one finding of a corpus; every third has no definition id."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= SPLIT if later else F.col("o_orderdate") < SPLIT)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("corpus"))
    top = o.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"), F.min("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n")).join(c, "o_custkey")
    key = F.col("o_custkey").cast("string")
    return top.select(
        "corpus", F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("d"), key)).alias("definition_id"), F.concat(F.lit("i"), key).alias("id"),
        F.when(F.col("s") == "F", "unreachable").when(F.col("s") == "P", "blocked").otherwise("alive").alias("state"),
        F.when(F.col("p") == "1-URGENT", "certain").when(F.col("p") == "2-HIGH", "high").otherwise("low").alias("confidence"),
        F.when(F.col("n") > 8, "verified_candidate").when(F.col("n") > 5, "review_candidate").when(F.col("n") > 3, "diagnostic").alias("actionability"),
        F.when(F.col("n") % 4 == 0, F.col("n") % 8 == 0).alias("candidate"),
    )


def _labels(spark, sf_dir):
    """A label for the definition id of every second customer and for the logical id of every fifth; some lack a reviewer."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    value = F.element_at(F.array(*[F.lit(v) for v in ("dead", "alive", "external", "unknown", "odd")]), (key % 5 + 1).cast("int"))
    label = F.struct(value.alias("value"), F.lit("seen").alias("rationale"), F.when(key % 7 > 0, "r").otherwise(" ").alias("reviewer"))
    one = lambda rows, prefix: rows.select(F.col("c_mktsegment").alias("corpus"), F.concat(F.lit(prefix), key.cast("string")).alias("target"), label.alias("label"))
    return one(c.filter("c_custkey % 2 = 0"), "d").unionByName(one(c.filter("c_custkey % 5 = 0"), "i"))


def _reviews(changes):
    """A review for the logical id of every change of an even customer, and one for the definition id of a third of them."""
    key = F.substring("id", 2, 20).cast("long")
    outcome = F.when(key % 4 == 0, "false_positive").when(key % 4 == 2, "true_positive").otherwise("perhaps")
    review = F.struct(outcome.alias("outcome"), F.lit("seen").alias("rationale"), F.when(key % 10 > 0, "r").alias("reviewer"))
    rows = changes.select("corpus", "change", "id", "definition_id", key.alias("k"), review.alias("review"))
    logical = rows.filter("k % 2 = 0").select("corpus", "change", F.col("id").alias("target"), "review")
    return logical.unionByName(rows.filter("k % 3 = 1 and definition_id is not null").select("corpus", "change", F.col("definition_id").alias("target"), "review"))


def _policies(spark, sf_dir):
    """BUILDING reviews everything, MACHINERY nothing, the others four of a stratum."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("corpus")).distinct().filter("corpus <> 'MACHINERY'")
    return segments.select("corpus", F.when(F.col("corpus") != "BUILDING", 4).alias("minimum"))


FINDINGS = f"""WITH t AS (SELECT c_mktsegment AS corpus, o_custkey AS k, o_orderdate >= '{SPLIT}' AS later, max(o_orderstatus) AS s, min(o_orderpriority) AS p, count(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
f AS (SELECT corpus, k, later, CASE WHEN k % 3 > 0 THEN 'd' || k END AS definition_id, 'i' || k AS id, CASE s WHEN 'F' THEN 'unreachable' WHEN 'P' THEN 'blocked' ELSE 'alive' END AS state,
CASE p WHEN '1-URGENT' THEN 'certain' WHEN '2-HIGH' THEN 'high' ELSE 'low' END AS confidence,
CASE WHEN n > 8 THEN 'verified_candidate' WHEN n > 5 THEN 'review_candidate' WHEN n > 3 THEN 'diagnostic' END AS actionability, CASE WHEN n % 4 = 0 THEN n % 8 = 0 END AS candidate FROM t),
g AS (SELECT *, coalesce(definition_id, id) AS identity, confidence IN ('certain', 'high') AND coalesce(candidate, state = 'unreachable') AS strong FROM f),
j AS (SELECT corpus, k, b.identity AS bi, a.identity AS ai, coalesce(a.identity, b.identity) AS identity, coalesce(a.definition_id, b.definition_id) AS definition_id, coalesce(a.id, b.id) AS id,
b.state AS bs, a.state AS s, b.confidence AS bc, a.confidence AS c, b.actionability AS ba, a.actionability AS act
FROM (SELECT * FROM g WHERE NOT later) b FULL JOIN (SELECT * FROM g WHERE later) a USING (corpus, k)),
changes AS (SELECT * FROM (SELECT corpus, k, unnest([CASE WHEN bi IS NULL THEN 'added' END, CASE WHEN ai IS NULL THEN 'removed' END, CASE WHEN bi = ai AND s <> bs THEN 'state_changed' END,
CASE WHEN bi = ai AND c <> bc THEN 'confidence_changed' END, CASE WHEN bi = ai AND act IS DISTINCT FROM ba THEN 'actionability_changed' END]) AS change, identity, definition_id, id, bs AS before_state, s AS after_state FROM j) WHERE change IS NOT NULL),
label AS (SELECT c_custkey AS k, ['dead', 'alive', 'external', 'unknown', 'odd'][c_custkey % 5 + 1] AS value, c_custkey % 7 > 0 AS signed FROM customer),
fresh AS (SELECT a.*, CASE WHEN a.k % 2 = 0 AND a.k % 3 > 0 THEN 'physical' WHEN a.k % 5 = 0 THEN 'logical' END AS match FROM g a WHERE later AND strong AND NOT EXISTS (SELECT 1 FROM g b WHERE NOT b.later AND b.strong AND b.corpus = a.corpus AND b.k = a.k)),
new_high AS (SELECT fresh.*, CASE WHEN match IS NOT NULL THEN value END AS value, match IS NOT NULL AND signed AND value <> 'odd' AS valid FROM fresh JOIN label USING (k)),
owed AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY corpus, change, before_state, after_state ORDER BY id, coalesce(definition_id, '')) AS r FROM changes
WHERE corpus <> 'MACHINERY' AND change IN ('added', 'removed', 'state_changed')) WHERE corpus = 'BUILDING' OR r <= 4),
reviewed AS (SELECT *, CASE WHEN k % 3 = 1 THEN 'physical' WHEN k % 2 = 0 THEN 'logical' END AS match, CASE k % 4 WHEN 0 THEN 'false_positive' WHEN 2 THEN 'true_positive' ELSE 'perhaps' END AS outcome FROM owed),
status AS (SELECT *, CASE WHEN match IS NULL THEN 'missing' WHEN k % 10 > 0 AND outcome <> 'perhaps' THEN 'completed' ELSE 'invalid' END AS status FROM reviewed)"""


@query(f"{FINDINGS} SELECT corpus, change, identity, definition_id, id, before_state, after_state FROM changes")
def release_changes(spark, sf_dir):
    return release.compare(_report(spark, sf_dir, False), _report(spark, sf_dir, True))


@query(f"{FINDINGS} SELECT corpus, identity, definition_id, id, value, match FROM new_high")
def newly_high(spark, sf_dir):
    found = release.newly_high(_report(spark, sf_dir, False), _report(spark, sf_dir, True), _labels(spark, sf_dir))
    return found.withColumn("value", F.col("label.value")).drop("label")


def _reviewed(spark, sf_dir):
    changes = release.compare(_report(spark, sf_dir, False), _report(spark, sf_dir, True))
    return release.review_status(release.required_reviews(changes, _policies(spark, sf_dir)), _reviews(changes))


@query(f"{FINDINGS} SELECT corpus, change, identity, before_state, after_state, match, status FROM status")
def release_reviews(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("corpus", "change", "identity", "before_state", "after_state", "match", "status")


@query(f"""{FINDINGS}, p AS (SELECT event_type, avg(value) <= 60 AS passed FROM events GROUP BY 1),
gates AS (SELECT 'new_high_reviewed' AS gate, count(*) FILTER (NOT valid) AS failures FROM new_high UNION ALL SELECT 'new_high_false_positives', count(*) FILTER (value IN ('alive', 'external')) FROM new_high
UNION ALL SELECT 'new_high_unresolved', count(*) FILTER (value = 'unknown') FROM new_high UNION ALL SELECT 'difference_review', count(*) FILTER (status <> 'completed') FROM status
UNION ALL SELECT 'review_false_positives', count(*) FILTER (status = 'completed' AND outcome = 'false_positive') FROM status UNION ALL SELECT 'performance', count(*) FILTER (NOT passed) FROM p UNION ALL SELECT 'adversarial', 0)
SELECT gate, failures = 0 AS passed, failures FROM gates""")
def release_gates(spark, sf_dir):
    new = release.newly_high(_report(spark, sf_dir, False), _report(spark, sf_dir, True), _labels(spark, sf_dir))
    checks = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") <= 60).alias("passed")).select(F.lit("performance").alias("gate"), "passed")
    return release.release_gates(new, _reviewed(spark, sf_dir), checks)


@query(f"""{FINDINGS} SELECT corpus, id, CASE WHEN actionability IN ('verified_candidate', 'review_candidate') THEN actionability WHEN confidence IN ('certain', 'high') THEN 'high_candidate' ELSE 'candidate' END AS review_class
FROM f WHERE later AND CASE WHEN actionability IS NOT NULL THEN actionability IN ('verified_candidate', 'review_candidate') ELSE coalesce(candidate, false) OR state = 'unreachable' END""")
def review_candidates(spark, sf_dir):
    return _report(spark, sf_dir, True).filter(release.reviewable()).select("corpus", "id", release.review_class().alias("review_class"))


@query("""WITH m AS (SELECT lang, count(*) FILTER (n_chars > 1000) AS n, count(*) FILTER (n_chars > 1000 AND quality = 1) AS good, count(*) FILTER (quality = 1) AS known
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT lang, coalesce(good / nullif(n, 0) >= 0.4, false) AS precision_held, n > 0 AS yield_held, coalesce(good / nullif(known, 0) >= 0.3, false) AS recall_held,
coalesce(good / nullif(n, 0) >= 0.4, false) AND n > 0 AND coalesce(good / nullif(known, 0) >= 0.3, false) AS passed FROM m""")
def release_criteria(spark, sf_dir):
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d, long, good = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(quality, "doc_id", "left"), F.col("n_chars") > 1000, F.col("quality") == 1
    counts = d.groupBy("lang").agg(F.count_if(long).alias("candidate_count"), F.count_if(long & good).alias("_g"), F.count_if(good).alias("_k"))
    part = lambda of: F.when(F.col(of) > 0, F.col("_g") / F.col(of))
    measured = counts.withColumn("candidate_precision", part("candidate_count")).withColumn("known_positive_recall", part("_k"))
    out = release.release_criteria(measured, 0.4, 0.3)
    return out.select("lang", F.col("checks.precision").alias("precision_held"), F.col("checks.candidate_yield").alias("yield_held"), F.col("checks.recall").alias("recall_held"), "passed")


@query("""SELECT o_custkey AS caller_id, l_partkey AS callee_id, count(DISTINCT l_returnflag || l_linestatus) AS n_evidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND l_returnflag || l_linestatus IN ('RF', 'NO') GROUP BY ALL""")
def outgoing_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(F.col("o_custkey").alias("caller_id"), F.col("l_partkey").alias("callee_id"), F.concat("l_returnflag", "l_linestatus").alias("evidence_id"))
    grades = edges.select("evidence_id").distinct().select("evidence_id", F.when(F.col("evidence_id") == "RF", "exact").when(F.col("evidence_id") == "NO", "observed").otherwise("heuristic").alias("grade"), F.lit(True).alias("verified"))
    callers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("definition_id"))
    return adjacency.outgoing(callers, edges, grades, "exact").select("caller_id", "callee_id", F.size("evidence_ids").cast("long").alias("n_evidence"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), l AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey AS caller, l_partkey AS callee, 'structured' AS source, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT l_suppkey, l_partkey, 'legacy', count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_suppkey = l.l_suppkey AND s.l_partkey = l.l_partkey) GROUP BY ALL""")
def preferred_edges(spark, sf_dir):
    of = lambda flag: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"))
    return adjacency.preferred_edges(of("A"), of("R")).groupBy("caller", "callee", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM part) AS definitions, (SELECT count(*) FROM lineitem) AS call_sites, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS edges,
(SELECT count(*) FROM customer WHERE c_acctbal < 0) AS blockers, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS shared_lookups""")
def graph_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return adjacency.counts(
        table(spark, sf_dir, "part"), lines, lines.select(F.col("l_suppkey").alias("caller_id"), F.col("l_partkey").alias("callee_id")), table(spark, sf_dir, "customer").filter("c_acctbal < 0"), ["l_partkey", "l_suppkey"]
    )


@query("""SELECT 'f' || p_size % 5 AS file, p_size AS line, p_brand AS owner, lower(p_type) AS macro, count(*) AS n_methods, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS methods
FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL""")
def generated_macros(spark, sf_dir):
    via = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.concat(F.lit("rails_"), F.lower("p_type"))).otherwise("def")
    file = F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("file")
    nodes = table(spark, sf_dir, "part").select(file, F.col("p_size").alias("line"), F.col("p_brand").alias("owner"), via.alias("defined_via"), F.col("p_name").alias("name"))
    return adjacency.generated_macros(nodes).withColumn("methods", F.array_join("methods", ","))


@query("""WITH known AS (SELECT DISTINCT c_custkey AS candidate FROM customer WHERE c_acctbal > 0),
g AS (SELECT o_orderkey AS site, unnest([o_custkey + 100000, o_custkey, o_custkey % 7]) AS candidate, unnest([1, 2, 3]) AS pos FROM orders)
SELECT g.site, arg_min(g.candidate, CASE WHEN k.candidate IS NULL THEN 10 ELSE 0 END + pos) AS candidate FROM g LEFT JOIN known k ON k.candidate = g.candidate GROUP BY g.site""")
def first_known_names(spark, sf_dir):
    key = F.col("o_custkey").cast("long")
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.array(key + 100000, key, key % 7).alias("candidates"))
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("candidate"))
    return adjacency.first_known(groups, known, ["site"])
