"""Registered queries of operators that answer single questions: lookups, checks, gates, roots, names, facts; beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import canonical, scalars
from factloom.operators import blockers, chains, diagnose, dispatch, evaluate, evidence, flow, guard, roots
from factloom.plans.registry import query
from factloom.sources import universe
from factloom.sources.tables import table

NONE = "array<string>"


def _text(prefix: str, col):
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def _pick(col, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (col % len(names) + 1).cast("int"))


def _classes(spark, sf_dir):
    """Nations below regions; every nation extends one of three modules; region 4 is dynamic."""
    empty = F.array().cast(NONE)
    row = lambda df, i, above, extended: df.select(i.alias("id"), F.lit("class").alias("kind"), above.alias("superclass"), empty.alias("includes"), empty.alias("prepends"), extended.alias("singleton_includes"), empty.alias("singleton_prepends"), (i == "R4").alias("dynamic"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    below = row(n, _text("N", "n_nationkey"), _text("R", "n_regionkey"), F.array(_text("M", F.col("n_nationkey") % 3)))
    return below.unionByName(row(r, _text("R", "r_regionkey"), F.lit(None).cast("string"), empty))


@query("SELECT 'N' || n_nationkey AS owner, 'N' || n_nationkey AS candidate FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation")
def class_descendants(spark, sf_dir):
    return chains.descendants(_classes(spark, sf_dir))


@query("SELECT DISTINCT a AS ancestor, o AS owner FROM (SELECT 'N' || n_nationkey AS a, unnest(['N' || n_nationkey, 'R' || n_regionkey]) AS o FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation)")
def reachable_owners(spark, sf_dir):
    return chains.reachable_owners(_classes(spark, sf_dir))


@query("SELECT 'N' || n_nationkey AS owner, p AS pos, c AS candidate, s AS sep FROM nation, LATERAL (VALUES (0, 'N' || n_nationkey, '.'), (1, 'M' || n_nationkey % 3, '#'), (2, 'R' || n_regionkey, '.')) t(p, c, s) UNION ALL SELECT 'R' || r_regionkey, 0, 'R' || r_regionkey, '.' FROM region")
def singleton_chains(spark, sf_dir):
    return chains.singleton_chains(_classes(spark, sf_dir))


@query(
    """WITH a AS (SELECT p_partkey, p_size % 5 AS given, p_size % 2 = 1 AS kw, p_partkey % 3 AS low, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 + 1 END AS high, p_partkey % 5 = 0 AS req, p_partkey % 5 < 3 AS acc, p_partkey % 7 = 0 AS rest FROM part),
b AS (SELECT *, rest OR req OR acc AS takes FROM a), c AS (SELECT *, given + CASE WHEN kw AND NOT takes THEN 1 ELSE 0 END AS n FROM b)
SELECT p_partkey, n < low OR coalesce(n > high, false) OR (takes AND ((req AND NOT kw) OR (NOT rest AND kw AND NOT acc))) AS rejected FROM c"""
)
def arity_rejections(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    one = lambda when: F.when(when, F.array(F.lit("a"))).otherwise(F.array().cast(NONE))
    out = dispatch.arity_rejected(size % 5, one(size % 2 == 1), k % 3, F.when(k % 4 > 0, k % 3 + 1), one(k % 5 == 0), one(k % 5 < 3), k % 7 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("rejected"))


@query(
    """WITH f AS (SELECT 'N' || n_nationkey AS o, unnest(['N' || n_nationkey, 'R' || n_regionkey]) AS m FROM nation), s AS (SELECT c_custkey AS site, 'N' || c_nationkey AS c, 'N' || c_custkey % 25 AS r, 'R' || c_custkey % 6 AS t, c_custkey % 3 AS v, c_custkey % 5 AS k FROM customer)
SELECT site, CASE WHEN v > 0 THEN true WHEN k = 0 THEN false WHEN k IN (1, 2) THEN true WHEN t IN ('R4', 'R5') THEN NULL ELSE EXISTS (SELECT 1 FROM f WHERE o = c AND m = t) AND EXISTS (SELECT 1 FROM f WHERE o = r AND m = t) END AS protected_ok FROM s"""
)
def protected_outcomes(spark, sf_dir):
    k = F.col("c_custkey")
    sites = table(spark, sf_dir, "customer").select(
        k.alias("site"), _text("N", "c_nationkey").alias("caller_owner"), _text("N", k % 25).alias("receiver_owner"), _text("R", k % 6).alias("target_owner"), F.when(k % 3 == 0, "protected").otherwise("public").alias("visibility"),
        F.when(k % 5 == 1, "self").otherwise("instance").alias("receiver_kind"), F.when(k % 5 == 0, "public_send").when(k % 5 == 2, "send").alias("original"),
    )
    classes = _classes(spark, sf_dir)
    return dispatch.protected_outcome(sites, chains.method_chains(classes), classes).select("site", "protected_ok")


@query(
    """WITH q AS (SELECT n_name AS id FROM nation UNION SELECT 'P' || n_nationkey FROM nation UNION SELECT DISTINCT p_name FROM part), s AS (SELECT p_name AS id, count(*) AS n, min('P' || p_partkey) AS one FROM part GROUP BY 1)
SELECT q.id, CASE WHEN n = 1 OR (n IS NULL AND p_partkey IS NOT NULL) THEN 'node' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN n = 1 THEN one WHEN n IS NULL AND p_partkey IS NOT NULL THEN q.id END AS definition_id FROM q LEFT JOIN s USING (id) LEFT JOIN part ON 'P' || p_partkey = q.id"""
)
def asked_definitions(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(_text("P", "p_partkey").alias("definition_id"), F.col("p_name").alias("symbol_id"))
    n = table(spark, sf_dir, "nation")
    ids = n.select(F.col("n_name").alias("id")).union(n.select(_text("P", "n_nationkey"))).union(nodes.select("symbol_id"))
    return diagnose.asked(ids, nodes).select("id", "status", "definition_id")


@query(
    """WITH r AS (SELECT o_orderkey AS s, o_orderstatus = 'F' AND o_orderkey % 10 = 0 AS scoped, o_custkey % 200 AS t FROM orders), ids AS (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 3 > 0)
SELECT 'complete_resolution_has_unknown_scope' AS code, s::VARCHAR AS subject FROM r WHERE scoped UNION ALL SELECT 'resolution_call_site_missing', s::VARCHAR FROM r WHERE NOT scoped AND s NOT IN (SELECT s FROM ids)
UNION ALL SELECT 'resolution_target_missing', s::VARCHAR FROM r WHERE NOT scoped AND s IN (SELECT s FROM ids) AND t NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'derived_call_site_has_no_resolution', (-s_suppkey - 1)::VARCHAR FROM supplier UNION ALL SELECT 'edge_has_no_evidence', l_partkey || '->' || l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) FILTER (l_linenumber = 1) = 0
UNION ALL SELECT 'actionable_finding_has_matching_blocker', 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 5 = 0"""
)
def graph_self_check(spark, sf_dir):
    o, s, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"), F.col("o_orderkey")
    res = o.select(k.alias("call_site_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("status"), F.when(k % 10 == 0, "message").alias("unknown_scope"), F.array(F.col("o_custkey") % 200).alias("target_definition_ids"))
    sites = o.filter(k % 3 > 0).select(k.alias("call_site_id"), F.lit(None).cast("long").alias("derived_from")).unionByName(s.select((-F.col("s_suppkey") - 1).alias("call_site_id"), F.col("s_suppkey").alias("derived_from")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller_id"), F.col("l_suppkey").alias("callee_id"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("evidence_id"))
    found = s.select(_text("S", "s_suppkey").alias("definition_id"), (F.col("s_suppkey") % 2).alias("n_blockers"))
    return diagnose.self_check(res, sites, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("definition_id")), edges, found, s.filter("s_suppkey % 5 = 0").select(_text("S", "s_suppkey").alias("definition_id")))


@query("SELECT 'ci_threshold' AS name, 'issue' AS status, 'warning' AS severity, 0::BIGINT AS n UNION ALL SELECT 'analysis_health', CASE WHEN s = 'ok' THEN 'ok' ELSE 'issue' END, s, 0 FROM (SELECT CASE WHEN bool_or(o_orderstatus = 'P') THEN 'error' ELSE 'ok' END AS s FROM orders) UNION ALL SELECT 'scope', CASE WHEN count(*) > 0 THEN 'issue' ELSE 'ok' END, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM customer WHERE c_nationkey = 8 UNION ALL SELECT 'load_roots', CASE WHEN count(*) > 0 THEN 'issue' ELSE 'ok' END, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM supplier WHERE s_acctbal > 1000000")
def doctor_checks(spark, sf_dir):
    health = table(spark, sf_dir, "orders").agg(F.when(F.max(F.col("o_orderstatus") == "P"), "invalid").otherwise("complete").alias("status"))
    return diagnose.doctor(True, True, health, table(spark, sf_dir, "customer").filter("c_nationkey = 8"), table(spark, sf_dir, "supplier").filter("s_acctbal > 1000000"))


@query(
    """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1)
SELECT 'analysis_health' AS "check", false AS passed, 1::BIGINT AS n UNION ALL SELECT 'ratchet', (SELECT count(*) FROM a) <= (SELECT count(*) FROM b), (SELECT count(*) FROM a) - (SELECT count(*) FROM b)
UNION ALL SELECT 'new_candidates', count(*) = 0, count(*) FROM a WHERE k NOT IN (SELECT k FROM b) AND k % 3 = 0"""
)
def ci_checks(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey")
    side = lambda rows: rows.select(key.cast("string").alias("physical_fingerprint"), _text("f", key % 3).alias("file"), F.lit("low").alias("confidence")).distinct()
    now = side(o.filter("o_orderstatus = 'F'")).withColumn("is_candidate", F.lit(True))
    return guard.ci_check(now, side(o.filter(F.col("o_orderdate") < "1997-01-01")), "degraded", ["scope"], ["scope", "parse"], spark.createDataFrame([("f0",)], "file string"))


@query("SELECT bool_and(coalesce(c_acctbal > -100000, false)) AS passed, count(*) AS n_checks, '' AS failed FROM customer UNION ALL SELECT bool_and(s_acctbal > 0), count(*), coalesce(array_to_string(list_sort(list('S' || s_suppkey) FILTER (s_acctbal <= 0)), ','), '') FROM supplier")
def gates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(_text("C", "c_custkey").alias("check"), (F.col("c_acctbal") > -100000).alias("passed"))
    s = table(spark, sf_dir, "supplier").select(_text("S", "s_suppkey").alias("check"), (F.col("s_acctbal") > 0).alias("passed"))
    return evaluate.gate(c).unionByName(evaluate.gate(s)).withColumn("failed", F.array_join("failed", ","))


@query("SELECT 'C' || c_custkey AS definition_id, CASE WHEN n IS NULL THEN 'alive' ELSE 'finding' END AS status, n::DOUBLE AS score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def explained_findings(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(_text("C", "o_custkey").alias("definition_id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return diagnose.explain(table(spark, sf_dir, "customer").select(_text("C", "c_custkey").alias("definition_id")), found).select("definition_id", "status", "score")


@query("SELECT l_orderkey AS evidence_id, count(DISTINCT l_suppkey) AS n_payloads, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey))[1:50], ',') AS payloads, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS domains FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def collision_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), _text("s", "l_suppkey").alias("payload_digest"), "l_returnflag")
    out = evidence.collision_report(rows, "l_returnflag")
    return out.select("evidence_id", "n_payloads", F.array_join("payloads", ",").alias("payloads"), F.array_join("domains", ",").alias("domains"))


@query("SELECT o_orderkey, o_orderkey % 4 > 0 AND o_orderstatus = 'F' AND o_orderkey % 5 <> 1 AS verified FROM orders")
def observed_scopes(spark, sf_dir):
    k = F.col("o_orderkey")
    asked = F.when(k % 4 > 0, F.create_map(F.lit("source_revision"), F.lit("F"))).otherwise(F.create_map(F.lit("env"), F.lit("x")))
    actual = F.create_map(F.lit("source_revision"), F.col("o_orderstatus"), F.lit("env"), F.lit("x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.observed_verified(actual, asked, F.when(k % 5 == 1, "stale")).alias("verified"))


@query("SELECT v AS value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) GROUP BY 1")
def tallies(spark, sf_dir):
    return evaluate.tally(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("words")), "words")


@query("SELECT p_brand, m AS measure, round(a - b, 4) AS delta FROM (SELECT p_brand, avg(p_size) FILTER (p_partkey % 2 = 0) AS a1, avg(p_size) FILTER (p_partkey % 2 = 1) AS b1, count(*) FILTER (p_partkey % 2 = 0) AS a2, count(*) FILTER (p_partkey % 2 = 1) AS b2 FROM part GROUP BY 1), LATERAL (VALUES ('size', a1, b1), ('n', nullif(a2, 0)::DOUBLE, nullif(b2, 0)::DOUBLE)) t(m, a, b)")
def ablation_deltas(spark, sf_dir):
    side = lambda k: table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return evaluate.ablation(side(0), side(1), ["p_brand"], ["size", "n"])


@query("SELECT o_custkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) THEN 'repeated' ELSE 'unmatched' END AS fault FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) UNION ALL SELECT o_custkey, 'repeated' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 1 HAVING count(*) > 1")
def label_faults(spark, sf_dir):
    candidates = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("value"))
    return evaluate.attach_labels(candidates, labels, ["id"])[1]


@query("SELECT sum(p_size)::BIGINT AS candidate_count, sum(p_partkey)::BIGINT AS candidate_loc, count(*) AS diagnostic_count, count(*) AS blocked_count, sum(p_size % 3)::BIGINT AS unknown_count, round(count(*) / (sum(p_size) + count(*)), 4)::DOUBLE AS blocked_rate, round(sum(p_size % 3) / (sum(p_size) + count(*)), 4)::DOUBLE AS unknown_rate, round(sum(p_size % 2) / sum(p_size), 4)::DOUBLE AS unknown_resolution_rate FROM part")
def aggregate_quality(spark, sf_dir):
    one = F.lit(1)
    given = {"candidate_count": F.col("p_size"), "candidate_loc": F.col("p_partkey"), "diagnostic_count": one, "blocked_count": one, "unknown_count": F.col("p_size") % 3, "resolution_total": F.col("p_size"), "resolution_unknown": F.col("p_size") % 2}
    return evaluate.aggregate_quality(table(spark, sf_dir, "part").select(*[c.alias(n) for n, c in given.items()]))


@query("SELECT c_custkey AS definition_id, 'added_candidate' AS violation FROM customer WHERE c_nationkey < 5 AND NOT c_nationkey < 3 UNION ALL SELECT c_custkey, 'blocked_candidate' FROM customer WHERE c_nationkey < 5 AND c_custkey % 4 = 0")
def safety_violations(spark, sf_dir):
    side = lambda n: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("definition_id"), (F.col("c_nationkey") < n).alias("is_candidate"), (F.col("c_custkey") % 4 == 0).alias("is_blocked"))
    return evaluate.safety_violations(side(3), side(5))


@query("SELECT count(*) AS n, array_to_string(CASE WHEN count(*) <= 64 THEN list_sort(list(s)) ELSE list_sort(list(s))[1:16] END, ',') AS sample FROM (SELECT DISTINCT 'S' || s_suppkey AS s FROM supplier)")
def instantiated_sample(spark, sf_dir):
    return evaluate.instantiated_sample(table(spark, sf_dir, "supplier").select(_text("S", "s_suppkey").alias("name"))).select("n", F.array_join("sample", ",").alias("sample"))


ROOTS = "n AS (SELECT 'C' || c_custkey AS id, c_custkey % 3 AS k, c_custkey % 5 = 0 AS test, c_nationkey AS n FROM customer)"


def _root_nodes(spark, sf_dir):
    """Customers as top-level code, instance and singleton methods in turn, of a file a nation; every fifth is a test's."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text("C", k).alias("definition_id"), _pick(k, ["block_entry", "instance_method", "singleton_method"]).alias("kind"), F.concat(_text("lib/n", "c_nationkey"), F.lit(".rb")).alias("file"), (k % 5 == 0).alias("test"), F.when(F.col("c_nationkey") % 2 == 0, "public").otherwise("private").alias("visibility"), F.concat(_text("N", "c_nationkey"), F.lit("#m"), k % 3).alias("symbol_id"),
    )


@query(
    f"""WITH {ROOTS} SELECT id AS definition_id, 'runtime' AS domain, 'main_script' AS reason FROM n WHERE k = 0 AND NOT test AND n < 10 UNION ALL SELECT id, 'external', 'public_api_declared' FROM n WHERE NOT test AND n BETWEEN 20 AND 24 UNION ALL SELECT id, 'runtime', 'public_api_declared' FROM n WHERE k = 2 AND n % 2 = 0 AND n IN (6, 7)
UNION ALL SELECT id, 'test', 'test_suite' FROM n WHERE k = 0 AND test UNION ALL SELECT id, 'runtime', 'production_load_unit' FROM n WHERE k = 0 AND NOT test UNION ALL SELECT id, 'external', 'library_public_api' FROM n WHERE k > 0 AND NOT test AND n % 2 = 0"""
)
def entry_roots(spark, sf_dir):
    nodes = _root_nodes(spark, sf_dir)
    files = spark.createDataFrame([("lib/n6.rb",), ("lib/n7.rb",)], "file string")
    parts = [roots.script_roots(nodes, ["lib/n?.rb"]), roots.declared_roots(nodes, ["N2?#*"], library=True), roots.library_file_roots(nodes, files), roots.test_roots(nodes), roots.load_roots(nodes), roots.library_surface(nodes)[0]]
    return roots.merged(*parts)


@query(f"WITH {ROOTS} SELECT 'open_public_api:' || id AS blocker_id, id AS scope_value FROM n WHERE k > 0 AND NOT test AND n % 2 = 0")
def library_blockers(spark, sf_dir):
    return roots.library_surface(_root_nodes(spark, sf_dir))[1].select("blocker_id", "scope_value")


@query(f"WITH {ROOTS}, u AS (SELECT DISTINCT 'lib/n' || n || '.rb' AS f FROM n WHERE k = 0 AND NOT test AND n > 3 AND substr(id, 2)::BIGINT IN (SELECT o_custkey FROM orders)) SELECT count(*) AS n_units, array_to_string(list_sort(list(f))[1:50], ',') AS files FROM u")
def unrooted_units(spark, sf_dir):
    nodes = _root_nodes(spark, sf_dir)
    reached = table(spark, sf_dir, "customer").filter("c_nationkey <= 3").select(_text("C", "c_custkey").alias("definition_id"))
    out = roots.unrooted_units(nodes, reached, table(spark, sf_dir, "orders").select(_text("C", "o_custkey").alias("caller_id")))
    return out.select("n_units", F.array_join("files", ",").alias("files"))


@query("SELECT p_partkey, list_reduce(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), lambda a, b: a || b) AS camel, p_name AS method FROM part")
def name_spellings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.lower_camel(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("camel"), scalars.method_name(F.concat("p_brand", F.lit("."), "p_name")).alias("method")).withColumn("method", F.regexp_replace("method", r"^\d*\.", ""))


@query("SELECT DISTINCT p_name, CASE WHEN w = 'widget' THEN 'widgetry' WHEN w = 'gear' THEN 'gear' WHEN regexp_matches(w, '(s|x)$') THEN w || 'es' ELSE w || 's' END AS plural FROM (SELECT p_name, split_part(p_name, ' ', 2) AS w FROM part)")
def plural_names(spark, sf_dir):
    noun = F.element_at(F.split("p_name", " "), 2)
    return table(spark, sf_dir, "part").select("p_name", scalars.pluralize(noun, {"widget": "widgetry"}, ["gear"], [("(s|x)$", "$1es")]).alias("plural")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'stale' WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN 'provided_unverified' WHEN o_orderstatus = 'F' THEN 'match' ELSE 'mismatch' END AS status FROM orders")
def revision_states(spark, sf_dir):
    k = F.col("o_orderkey")
    given, current = F.when(k % 3 > 0, F.col("o_orderstatus")), F.when(k % 7 > 0, "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.revision_status(given, current, k % 11 == 0).alias("status"))


@query("SELECT c_custkey, greatest(0.0, least(9000.0, greatest(c_acctbal * 1.5, c_acctbal + 100.0)))::DOUBLE AS cap, greatest(1, ceil((c_custkey % 50) / 24.0))::BIGINT AS days FROM customer")
def limits_and_days(spark, sf_dir):
    b, hours = F.col("c_acctbal").cast("double"), F.col("c_custkey") % 50
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.relative_limit(b, F.lit(1.5), F.lit(100.0), F.lit(9000.0)).alias("cap"), scalars.observation_days(start, F.timestamp_seconds(F.unix_timestamp(start) + hours * 3600)).cast("long").alias("days"))


@query("SELECT n_name, array_to_string([r_name || '::' || n_name, 'TOP::' || n_name, n_name], ',') AS names FROM nation JOIN region ON r_regionkey = n_regionkey")
def constant_names(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", F.array_join(scalars.constant_candidates(F.col("n_name"), F.array("r_name", F.lit("TOP"))), ",").alias("names"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 5 = 1 THEN 'parse_incomplete' WHEN p_partkey % 5 = 2 THEN 'generated_method' ELSE 'unused' END AS category FROM part) GROUP BY 1")
def category_counts(spark, sf_dir):
    k = F.col("p_partkey") % 5
    rows = table(spark, sf_dir, "part").select(F.when(k == 0, F.col("p_brand")).alias("category"), F.when(k == 1, F.array(F.lit("parse_incomplete"))).alias("blocker_kinds"), F.when(k == 2, "attr_reader").otherwise("def").alias("defined_via"), F.lit("unused").alias("classification"))
    return rows.groupBy(evaluate.category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n_results FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1")
def divergent_results(spark, sf_dir):
    return evidence.divergent(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem GROUP BY ALL")
def distinct_blockers(spark, sf_dir):
    key = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return blockers.dedupe(table(spark, sf_dir, "lineitem").select(*key), key).select(*key)


@query("SELECT false AS comparable, 'configuration_mismatch' AS reasons FROM (SELECT min(r_name) AS a, max(r_name) AS b FROM region) WHERE a <> b")
def comparability(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    side = lambda f: r.agg(F.min("r_regionkey").cast("string").alias("root"), f("r_name").alias("configuration_sha256"))
    return guard.comparability(side(F.min), side(F.max)).select("comparable", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT count(*) = 0 AS passed, count(*) AS n_missing FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW')")
def feedback_verdict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderstatus"]
    found = guard.feedback(o.filter("o_orderpriority = '5-LOW'"), o.filter("o_orderpriority = '1-URGENT'"), keys)
    return diagnose.feedback_verdict(found.filter("kind = 'missing_static'"), True)


@query(
    """SELECT r_name AS corpus, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0) ELSE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') END AS recalled
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def recalled_candidates(spark, sf_dir):
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("r_name").alias("corpus"))
    c = table(spark, sf_dir, "customer").join(place, F.col("n_nationkey") == F.col("c_nationkey"))
    known = c.select("corpus", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("definition_id"), F.col("c_custkey").alias("id"))
    hit = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    selected = c.join(hit, F.col("o_custkey") == F.col("c_custkey")).select("corpus", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("definition_id"), F.col("c_custkey").alias("id"))
    return evaluate.recalled(known, selected).select("corpus", "id", "recalled")


FLOWS = """WITH RECURSIVE flows AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem UNION SELECT 'P' || l_partkey, 'O' || l_orderkey FROM lineitem UNION SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders),
seeds AS (SELECT 'S' || s_suppkey AS var, CASE WHEN s_nationkey = 7 THEN 'class_object' ELSE 'instance_types' END AS kind, 'N' || s_nationkey AS v, s_suppkey % 97 > 0 AS exact FROM supplier),
walk(var, node) AS (SELECT var, var FROM seeds UNION SELECT w.var, f.dst FROM walk w JOIN flows f ON f.src = w.node),
g AS (SELECT node AS var, bool_and(exact) AS sure, count(DISTINCT kind) AS kinds, min(kind) AS kind, count(DISTINCT v) AS n, list_sort(list(DISTINCT v)) AS vs FROM walk JOIN seeds USING (var) GROUP BY 1)
SELECT var, CASE WHEN sure AND kinds = 1 AND n <= 8 THEN kind ELSE 'unknown' END AS kind, CASE WHEN sure AND kinds = 1 AND n <= 8 THEN array_to_string(vs, ',') ELSE '' END AS vals FROM g"""


@query(FLOWS)
def value_facts(spark, sf_dir):
    """What parts, orders and customers may hold of the nations of their suppliers."""
    line = table(spark, sf_dir, "lineitem")
    flows = line.select(_text("S", "l_suppkey").alias("src"), _text("P", "l_partkey").alias("dst"))
    flows = flows.unionByName(line.select(_text("P", "l_partkey").alias("src"), _text("O", "l_orderkey").alias("dst")))
    flows = flows.unionByName(table(spark, sf_dir, "orders").select(_text("O", "o_orderkey").alias("src"), _text("C", "o_custkey").alias("dst")))
    s = table(spark, sf_dir, "supplier")
    seeds = s.select(_text("S", "s_suppkey").alias("var"), F.when(F.col("s_nationkey") == 7, "class_object").otherwise("instance_types").alias("kind"), F.array(_text("N", "s_nationkey")).alias("values"), (F.col("s_suppkey") % 97 > 0).alias("exact"), F.lit(False).alias("nilable"))
    return flow.value_facts(seeds, flows).select("var", "kind", F.array_join("values", ",").alias("vals"))


@query(
    """WITH s AS (SELECT c_custkey AS site, 'N' || c_nationkey AS owner, CASE WHEN c_custkey % 4 > 0 THEN 'm' || c_custkey % 10 END AS name, c_custkey % 3 > 0 AS reflective FROM customer),
t AS (SELECT site, count(*) AS n FROM s JOIN supplier ON 'N' || s_nationkey = owner AND 'm' || s_suppkey % 10 = name WHERE reflective GROUP BY 1)
SELECT site, CASE WHEN n = 1 THEN 'complete' WHEN n > 1 THEN 'partial' ELSE 'unknown' END AS status, CASE WHEN NOT reflective THEN 'literal_callable_invocation' WHEN name IS NULL THEN 'callable_invocation_dynamic_name' WHEN n IS NULL THEN 'callable_invocation_missing' ELSE 'callable_invocation' END AS reason FROM s LEFT JOIN t USING (site)"""
)
def callable_lookups(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "supplier").select(_text("S", "s_suppkey").alias("definition_id"), F.lit("instance_method").alias("kind"), _text("N", "s_nationkey").alias("owner"), _text("m", F.col("s_suppkey") % 10).alias("name"))
    names = F.when(k % 4 > 0, F.array(_text("m", k % 10)))
    sites = table(spark, sf_dir, "customer").select(k.alias("site"), F.lit("nobody").alias("caller_id"), names.alias("names"), (k % 3 > 0).alias("reflective"), F.lit("instance").alias("receiver_kind"), F.array(_text("N", "c_nationkey")).alias("receiver_values"))
    return flow.callables(sites, nodes)[0]


def _hexed(sql: str) -> str:
    return f"""'["string",["UTF-8","' || lower(hex(encode({sql}))) || '"]]'"""


@query(
    f"""SELECT o_orderkey, 'call:v1:' || sha256('["array",[' || array_to_string([{_hexed("'source'")}, {_hexed("'C' || o_custkey")}, {_hexed("'a.rb'")}, {_hexed("'call'")}, {_hexed("o_orderpriority")}, {_hexed("''")}, '["integer","' || (o_orderkey % 9 + 1) || '"]'], ',') || ']]') AS call_site_id FROM orders"""
)
def call_site_ids(spark, sf_dir):
    f = canonical.source_call_id(_text("C", "o_custkey"), F.lit("a.rb"), F.lit("call"), F.col("o_orderpriority"), F.lit(None).cast("string"), (F.col("o_orderkey") % 9 + 1).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", f.alias("call_site_id"))


@query(f"""SELECT p_partkey, '["hash",[' || '[' || {_hexed("'brand'")} || ',' || {_hexed("p_brand")} || '],[' || {_hexed("'sizes'")} || ',["array",[["integer","' || p_size || '"],["nil"]]]]' || ']]' AS dump FROM part""")
def canonical_dumps(spark, sf_dir):
    kind = T.StructType.fromDDL("sizes array<int>, brand string")
    value = F.struct(F.array(F.col("p_size").cast("int"), F.lit(None).cast("int")).alias("sizes"), F.col("p_brand").alias("brand"))
    return table(spark, sf_dir, "part").select("p_partkey", canonical.dump(value, kind).alias("dump"))


FILES = """f AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'lib/a' WHEN 1 THEN 'spec/b' WHEN 2 THEN 'vendor/c' WHEN 3 THEN 'doc/d' WHEN 4 THEN '.hid/e' WHEN 5 THEN 'bin/f' WHEN 6 THEN 'lib/tasks/g' ELSE 'old/h' END || o_orderkey || CASE WHEN o_orderkey % 8 = 5 THEN '' WHEN o_orderkey % 8 = 3 THEN '.md' ELSE '.rb' END AS path, o_orderkey % 8 AS d, o_orderkey % 50 = 0 AS link, o_orderstatus FROM orders),
u AS (SELECT path, d, NOT link AND (d NOT IN (3, 5) OR o_orderstatus = 'F') AS source, CASE WHEN link THEN 'symlink' END AS issue, d = 1 AS test FROM f WHERE d NOT IN (2, 7)),
v AS (SELECT *, source AND d NOT IN (3, 4) AS analyzed, issue IS NULL AND ((source AND d NOT IN (3, 4)) OR d IN (0, 3, 6)) AS referenced FROM u)"""


def _universe(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(_pick(k, ["lib/a", "spec/b", "vendor/c", "doc/d", ".hid/e", "bin/f", "lib/tasks/g", "old/h"]), k.cast("string"), F.when(k % 8 == 5, "").when(k % 8 == 3, ".md").otherwise(".rb"))
    files = table(spark, sf_dir, "orders").select(name.alias("path"), (k % 50 == 0).alias("symlink"), F.when(F.col("o_orderstatus") == "F", "#!/usr/bin/env ruby").alias("first_line"))
    return universe.universe(files, universe.Scopes(reference=("lib/**", "doc/**"), exclude=("old/**",)))


@query(f"WITH {FILES} SELECT path, source, test, analyzed, referenced, issue, CASE WHEN analyzed THEN 'analyze' WHEN referenced THEN 'reference' ELSE 'excluded' END AS domain FROM v")
def file_sets(spark, sf_dir):
    return _universe(spark, sf_dir).drop("entry_outside")


@query(
    f"""WITH {FILES} SELECT count(*) FILTER (analyzed) AS n_analyzed, count(*) FILTER (referenced) AS n_referenced, count(*) FILTER (source AND NOT analyzed AND NOT referenced) AS n_outside, count(*) FILTER (issue IS NOT NULL AND NOT test) AS n_issues_runtime,
array_to_string(list_sort(list(path) FILTER (source AND NOT analyzed AND NOT referenced))[1:20], ',') AS samples FROM v"""
)
def scope_diagnostics(spark, sf_dir):
    return universe.scope_diagnostics(_universe(spark, sf_dir)).select("n_analyzed", "n_referenced", "n_outside", "n_issues_runtime", F.array_join("samples", ",").alias("samples"))
