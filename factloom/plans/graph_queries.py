"""Registered queries of dispatch, blockers, differences, evaluation and reports on the driver's tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import blockers, chains, dispatch, evaluate, evidence, guard, report, roots
from factloom.plans.registry import query
from factloom.sources.tables import table

SPLIT = "1998-01-01"
NONE = "array<string>"


def _text(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _classes(spark, sf_dir):
    """Nations below regions, each with modules and a prepended one; suppliers' classes have no lists."""
    n = table(spark, sf_dir, "nation")
    empty = F.array().cast(NONE)
    below = n.select(
        _text("N", "n_nationkey").alias("id"), F.lit("class").alias("kind"), _text("R", "n_regionkey").alias("superclass"),
        F.array(F.concat(F.lit("M"), F.col("n_nationkey") % 3), F.concat(F.lit("M"), F.col("n_nationkey") % 5)).alias("includes"), F.array(_text("P", "n_regionkey")).alias("prepends"),
        empty.alias("singleton_includes"), empty.alias("singleton_prepends"), F.lit(False).alias("dynamic"),
    )
    above = table(spark, sf_dir, "region").select(_text("R", "r_regionkey").alias("id"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("superclass"), *[empty.alias(c) for c in ("includes", "prepends", "singleton_includes", "singleton_prepends")], F.lit(False).alias("dynamic"))
    return below, above


@query("""WITH raw AS (SELECT 'N' || n_nationkey AS owner, 0 AS r, 'P' || n_regionkey AS c FROM nation UNION ALL SELECT 'N' || n_nationkey, 1, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || n_nationkey, 2, 'M' || n_nationkey % 5 FROM nation
UNION ALL SELECT 'N' || n_nationkey, 3, 'M' || n_nationkey % 3 FROM nation UNION ALL SELECT 'N' || n_nationkey, 4, 'R' || n_regionkey FROM nation),
one AS (SELECT owner, c, min(r) AS r FROM raw GROUP BY ALL) SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY r) - 1)::INTEGER AS pos, c AS candidate FROM one""")
def method_chains(spark, sf_dir):
    return chains.method_chains(_classes(spark, sf_dir)[0])


@query("""WITH up AS (SELECT 'S' || s_suppkey AS id, 'N' || s_nationkey AS a FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)
SELECT id AS owner, 1 AS pos, a AS candidate FROM up UNION ALL SELECT u.id, 2, v.a FROM up u JOIN up v ON v.id = u.a""")
def ancestor_chains(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    up = s.select(_text("S", "s_suppkey").alias("id"), _text("N", "s_nationkey").alias("superclass"))
    return chains.ancestors(up.unionByName(n.select(_text("N", "n_nationkey").alias("id"), _text("R", "n_regionkey").alias("superclass"))))


LOOKUP = """WITH m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_nationkey ELSE 'R' || n_regionkey END AS owner, s_suppkey % 10 AS msg, s_suppkey % 3 = 0 AS private FROM supplier JOIN nation ON n_nationkey = s_nationkey),
hit AS (SELECT c_custkey AS site, id, private, rank() OVER (PARTITION BY c_custkey ORDER BY owner[1]) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN m ON m.msg = c_custkey % 10 AND m.owner IN ('N' || c_nationkey, 'R' || n_regionkey))"""


def _lookup(spark, sf_dir):
    below, above = _classes(spark, sf_dir)
    plain = F.array().cast(NONE)
    classes = below.withColumn("includes", plain).withColumn("prepends", plain).unionByName(above)
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    nodes = s.select(
        _text("S", "s_suppkey").alias("definition_id"), F.lit("instance_method").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, _text("N", "s_nationkey")).otherwise(_text("R", "n_regionkey")).alias("owner"),
        F.concat(F.lit("m"), F.col("s_suppkey") % 10).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "private").otherwise("public").alias("visibility"), F.lit(False).alias("test"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    sites = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("site"), F.lit("nobody").alias("caller_id"), F.concat(F.lit("m"), F.col("c_custkey") % 10).alias("message"), F.lit("instance").alias("receiver_kind"), _text("N", "c_nationkey").alias("receiver_name"),
        F.lit(False).alias("dynamic"), F.lit(False).alias("test"), none("string").alias("physical_target"), none(NONE).alias("flow_types"), none("string").alias("original"),
    )
    return dispatch.method_lookup(sites, nodes, classes)


@query(f"{LOOKUP} SELECT site, 'S' || id AS definition_id FROM hit WHERE r = 1 AND NOT private")
def dispatch_targets(spark, sf_dir):
    return _lookup(spark, sf_dir)[1]


@query(f"{LOOKUP} SELECT site, 'S' || id AS definition_id, CASE WHEN r = 1 THEN 'private_visibility' ELSE 'shadowed_by_lookup_order' END AS reason FROM hit WHERE r > 1 OR private")
def dispatch_rejections(spark, sf_dir):
    return _lookup(spark, sf_dir)[2]


@query(f"{LOOKUP} SELECT CASE WHEN c_custkey IN (SELECT site FROM hit) THEN 'complete' ELSE 'unknown' END AS status, count(*) AS n FROM customer GROUP BY 1")
def dispatch_status(spark, sf_dir):
    return _lookup(spark, sf_dir)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS site, CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 3 > 0 AND c_acctbal < 0) THEN 'message' ELSE 'owner' END AS scope_kind,
CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 3 > 0 AND c_acctbal < 0) THEN 'm' || c_custkey % 10 WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'N' || c_nationkey END AS scope FROM customer""")
def residual_scopes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("site", F.col("c_custkey"))
    sites = c.select(
        "site", F.when(F.col("c_acctbal") >= 0, _text("C", "c_custkey")).alias("caller_id"), F.concat(F.lit("m"), F.col("c_custkey") % 10).alias("message"),
        F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise("instance").alias("receiver_kind"), F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))).alias("receivers"),
    )
    out = blockers.residual_scopes(sites, c.select(_text("C", "c_custkey").alias("definition_id"), _text("N", "c_nationkey").alias("owner")))
    return out.select("site", "scope_kind", F.array_join("scope_values", ",").alias("scope"))


@query("""SELECT 'duplicate:' || p_name AS blocker_id, count(*) AS n_definitions, array_to_string(list_sort(list('P' || p_partkey))[1:50], ',') AS ids FROM part WHERE p_size < 40 GROUP BY p_name HAVING count(*) > 1""")
def duplicate_definitions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol_id"), _text("P", "p_partkey").alias("definition_id"), (F.col("p_size") >= 40).alias("test"))
    return blockers.duplicate_definitions(p).select("blocker_id", "n_definitions", F.array_join("definition_ids", ",").alias("ids"))


RULES = [
    ("r1", "unknown_dispatch", "owner", "Brand#2", "exact", None, "instance", None, None, None),
    ("r2", "unknown_dispatch", "owner", "Brand#3", "exact", "red widget", "implicit", None, None, None),
    ("r3", "unknown_dispatch", "owner", "Brand#4", "exact", None, "instance", "public_send", None, None),
    ("r4", "unknown_dispatch", "owner", "Brand#5", "exact", None, "instance", "respond_to?", True, ["P5", "P30", "P55"]),
    ("r5", "duplicate_definition", "symbol", "red widget", "exact", "ignored", None, None, None, None),
    ("r6", "unknown_dispatch", "message", "{red,small}*", "glob", None, "constant", None, None, None),
]


@query("""WITH p AS (SELECT 'P' || p_partkey AS id, p_name, p_brand, CASE p_size % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS v FROM part)
SELECT b AS blocker_id, id AS definition_id FROM p, (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6')) t(b)
WHERE (b = 'r1' AND p_brand = 'Brand#2' AND v <> 'private') OR (b = 'r2' AND p_brand = 'Brand#3' AND p_name = 'red widget') OR (b = 'r3' AND p_brand = 'Brand#4' AND v = 'public')
OR (b = 'r4' AND p_brand = 'Brand#5' AND id NOT IN ('P5', 'P30', 'P55')) OR (b = 'r5' AND p_name = 'red widget') OR (b = 'r6' AND (p_name LIKE 'red%' OR p_name LIKE 'small%') AND v <> 'private')""")
def blocker_match_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "blocker_id string, kind string, scope_kind string, scope_value string, scope_match string, message string, receiver_kind string, original string, include_private boolean, known_targets array<string>")
    v = F.element_at(F.array(F.lit("private"), F.lit("protected"), F.lit("public")), F.col("p_size") % 3 + 1)
    nodes = table(spark, sf_dir, "part").select(_text("P", "p_partkey").alias("definition_id"), F.col("p_name").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"), F.col("p_type").alias("file"), F.array("p_brand").alias("namespaces"), v.alias("visibility"))
    return blockers.match(rules, nodes)


def _reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.max("o_orderstatus") == "F", "unreachable").when(F.max("o_orderstatus") == "O", "test_only_reachable").otherwise("blocked")
    side = lambda rows: rows.groupBy(F.col("o_custkey").alias("definition_id")).agg(kind.alias("classification"), F.lit(None).cast("string").alias("actionability"), F.lit(0).alias("n_blockers"))
    return side(o.filter(F.col("o_orderdate") < SPLIT)), side(o.filter(F.col("o_orderdate") >= SPLIT))


@query(f"""WITH b AS (SELECT o_custkey AS id, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < '{SPLIT}' GROUP BY 1), h AS (SELECT o_custkey AS id, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= '{SPLIT}' GROUP BY 1),
j AS (SELECT coalesce(b.id, h.id) AS id, b.s AS b, h.s AS h, coalesce(b.id, h.id) IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS seen FROM b FULL JOIN h ON h.id = b.id)
SELECT id AS definition_id, 'newly_unreachable' AS change FROM j WHERE h = 'F' AND b IS DISTINCT FROM 'F' UNION ALL SELECT id, 'newly_reachable' FROM j WHERE b = 'F' AND h IS NULL AND seen
UNION ALL SELECT id, 'newly_blocked' FROM j WHERE h = 'P' AND b IS DISTINCT FROM 'P' UNION ALL SELECT id, 'blocker_removed' FROM j WHERE b = 'P' AND h IS DISTINCT FROM 'P'""")
def causal_diff(spark, sf_dir):
    return guard.causal_diff(*_reports(spark, sf_dir), table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("definition_id")))


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate < '{SPLIT}' AS before, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'unknown' END AS st FROM orders),
b AS (SELECT o_custkey AS id, arg_max(st, o_orderkey) AS st FROM s WHERE before GROUP BY 1), h AS (SELECT o_custkey AS id, arg_max(st, o_orderkey) AS st FROM s WHERE NOT before GROUP BY 1)
SELECT id AS call_site_id, b.st AS "from", h.st AS "to" FROM b JOIN h USING (id) WHERE b.st = 'complete' AND h.st <> 'complete'""")
def dispatch_became_partial(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("call_site_id"), status.alias("status"), F.col("o_orderkey").alias("seq"), "o_orderdate")
    return guard.dispatch_became_partial(rows.filter(F.col("o_orderdate") < SPLIT), rows.filter(F.col("o_orderdate") >= SPLIT))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber, l_returnflag FROM lineitem), b AS (SELECT l_suppkey, l_partkey, l_linenumber FROM e WHERE l_returnflag = 'N'), h AS (SELECT l_suppkey, l_partkey, l_linenumber FROM e WHERE l_returnflag = 'R'),
u AS (SELECT *, 1 AS b, 0 AS h FROM b UNION ALL SELECT *, 0, 1 FROM h), g AS (SELECT l_suppkey, l_partkey, l_linenumber, max(b) AS b, max(h) AS h FROM u GROUP BY ALL)
SELECT p_partkey AS definition_id, coalesce(sum(b), 0)::BIGINT AS n_base, coalesce(sum(h), 0)::BIGINT AS n_head, coalesce(sum(b * (1 - h)), 0)::BIGINT AS n_removed FROM part LEFT JOIN g ON l_partkey = p_partkey GROUP BY 1""")
def removed_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller_id"), F.col("l_partkey").alias("callee_id"), F.col("l_linenumber").alias("call_site_id"), "l_returnflag")
    return guard.removed_edges(lines.filter("l_returnflag = 'N'"), lines.filter("l_returnflag = 'R'"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("definition_id")))


@query("""WITH e AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS d, o_custkey AS y, o_orderstatus AS path, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS body FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT o_orderkey AS finding, o_custkey AS y, o_orderstatus AS path FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
f AS (SELECT idx, finding, 0 AS o, 'exact' AS strategy FROM e JOIN c ON d = finding UNION ALL SELECT idx, finding, 1, 'body_digest' FROM e JOIN c ON body = c.y AND e.y = c.y AND e.path = c.path UNION ALL SELECT idx, finding, 2, 'symbol_path_hint' FROM e JOIN c ON e.y = c.y AND e.path = c.path),
k AS (SELECT idx, o, strategy, count(*) AS n, min(finding) AS finding FROM f GROUP BY idx, o, strategy), g AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY o) AS r FROM k)
SELECT e.idx, coalesce(strategy, 'unmatched') AS strategy, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN finding END AS finding FROM e LEFT JOIN g ON g.idx = e.idx AND r = 1""")
def baseline_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 3)
    entries = o.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("idx"), F.when(F.col("k") == 0, F.col("o_orderkey")).alias("definition_id"), F.lit(None).cast("long").alias("fingerprint"), F.when(F.col("k") == 1, F.col("o_custkey")).alias("body_digest"),
        F.col("o_custkey").alias("symbol_id"), F.col("o_orderstatus").alias("path"), F.lit("unreachable").alias("classification"),
    )
    current = o.filter("o_orderpriority in ('1-URGENT', '5-LOW')").select(
        F.col("o_orderkey").alias("finding"), F.col("o_orderkey").alias("definition_id"), F.lit(None).cast("long").alias("physical_fingerprint"), F.col("o_custkey").alias("body_digest"),
        F.col("o_custkey").alias("symbol_id"), F.col("o_orderstatus").alias("path"), F.lit("unreachable").alias("classification"),
    )
    return guard.baseline_cascade(entries, current)


def _doc_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("definition_id"), _text("s", "doc_id").alias("symbol_id"), "lang", (F.col("n_chars") > 2000).alias("is_candidate"), F.when(F.col("n_chars") > 8000, "blocked").otherwise("unreachable").alias("classification"),
        (F.col("n_chars") < 300).alias("is_unknown"), F.when(F.col("n_chars") != 5, F.lit(3)).alias("line"), (F.col("n_chars") % 50).alias("end_line"),
    )


@query("""WITH d AS (SELECT doc_id, lang, n_chars, n_chars > 2000 AS c, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
a AS (SELECT lang, count(*) FILTER (c) AS candidate_count, coalesce(sum(greatest(n_chars % 50 - 3 + 1, 1)) FILTER (c), 0)::BIGINT AS candidate_loc, count(*) AS finding_count, count(*) FILTER (NOT c) AS diagnostic_count, count(*) FILTER (n_chars > 8000) AS blocked_count, count(*) FILTER (n_chars < 300) AS unknown_count,
count(*) FILTER (quality = 1) AS known_positive_count, count(*) FILTER (quality = 1 AND c) AS hit FROM d GROUP BY 1)
SELECT * EXCLUDE (hit), CASE WHEN known_positive_count > 0 AND candidate_count > 0 THEN round(hit / candidate_count, 4) END AS candidate_precision, CASE WHEN known_positive_count > 0 THEN round(hit / known_positive_count, 4) END AS known_positive_recall,
round(blocked_count / finding_count, 4) AS blocked_rate, round(unknown_count / finding_count, 4) AS unknown_rate FROM a""")
def quality_by_language(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").filter("quality = 1").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(_text("s", "doc_id")).alias("id"))
    return evaluate.quality(_doc_findings(spark, sf_dir), gold, ["lang"])


@query("""WITH r AS (SELECT lang AS corpus, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'i' || doc_id END AS identity, n_chars FROM documents)
SELECT corpus, identity, n_chars < 1500 AS short, n_chars > 1000 AS long FROM r WHERE n_chars < 1500 OR n_chars > 1000""")
def candidate_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.when(F.col("doc_id") % 2 == 0, _text("d", "doc_id")).alias("definition_id"), _text("i", "doc_id").alias("id"), "n_chars")
    rows = d.withColumn("tool", F.lit("short")).withColumn("candidate", F.col("n_chars") < 1500).unionByName(d.withColumn("tool", F.lit("long")).withColumn("candidate", F.col("n_chars") > 1000))
    return evaluate.candidate_union(rows, ["short", "long"])


@query("""SELECT n, CASE WHEN max(s) = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT c_nationkey AS n, 0 AS s FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1 FROM supplier WHERE s_acctbal > 3000) GROUP BY n HAVING min(s) = max(s)""")
def symmetric_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    return evaluate.only_in(c, table(spark, sf_dir, "supplier").filter("s_acctbal > 3000").select(F.col("s_nationkey").alias("n")), ["n"])


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_orderstatus = 'O') AS unknown
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def resolution_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), status.alias("status"))
    return evaluate.resolution_counts(rows, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("file")))


def _order_findings(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "P", "blocked").when(F.col("o_orderstatus") == "O", "test_only_reachable").otherwise("unreachable")
    return table(spark, sf_dir, "orders").select(
        _text("O", "o_orderkey").alias("id"), F.concat_ws("%", "o_orderpriority", "o_orderstatus").alias("file"), (F.col("o_custkey") + 0).cast("int").alias("line"), kind.alias("classification"),
        F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low").alias("confidence"), F.when(F.col("o_orderstatus") == "F", "review_candidate").otherwise("diagnostic").alias("actionability"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS actionable, count(*) FILTER (o_orderstatus = 'P') AS blocked,
count(*) FILTER (o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_totalprice <= 100000)) AS diagnostic, count(*) FILTER (o_orderstatus = 'F') AS unreachable, count(*) FILTER (o_orderstatus = 'O') AS test_only_reachable, 0::BIGINT AS unused FROM orders""")
def report_summary(spark, sf_dir):
    return report.summary(_order_findings(spark, sf_dir), "medium")


@query("""SELECT '::warning file=' || o_orderpriority || '%25' || o_orderstatus || ',line=' || o_custkey || '::O' || o_orderkey || ' is ' || CASE o_orderstatus WHEN 'P' THEN 'blocked' WHEN 'O' THEN 'test_only_reachable' ELSE 'unreachable' END
|| ' (' || CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END || ')' AS value FROM orders""")
def ci_annotations(spark, sf_dir):
    return report.annotations(_order_findings(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT replace(p_name, ' ', '_') AS n FROM part) SELECT n AS name, n || CASE WHEN contains(n, '_') THEN ',' || split_part(n, '_', 1) || upper(split_part(n, '_', 2)[1]) || split_part(n, '_', 2)[2:] ELSE '' END AS tokens FROM t""")
def reference_tokens(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).distinct()
    return names.select("name", F.array_join(scalars.reference_tokens(F.col("name")), ",").alias("tokens"))


@query("""SELECT o_custkey AS caller_id, o_orderstatus AS callee_id, count(DISTINCT o_orderpriority) AS n_evidence FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL""")
def edge_relations(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller_id"), F.col("o_orderstatus").alias("callee_id"), F.col("o_orderpriority").alias("evidence_id"))
    graded = [("1-URGENT", "exact", False), ("2-HIGH", "observed", True), ("3-MEDIUM", "observed", False), ("5-LOW", "heuristic", True)]
    out = evidence.relations(edges, spark.createDataFrame(graded, "evidence_id string, grade string, verified boolean"), "exact")
    return out.select("caller_id", "callee_id", F.size("evidence_ids").cast("long").alias("n_evidence"))


@query("""SELECT 'P' || p_partkey AS definition_id, 'external' AS domain, 'library_public_api' AS reason FROM part WHERE p_size % 3 > 0 AND p_size < 30""")
def library_roots(spark, sf_dir):
    v = F.element_at(F.array(F.lit("private"), F.lit("protected"), F.lit("public")), F.col("p_size") % 3 + 1)
    nodes = table(spark, sf_dir, "part").select(_text("P", "p_partkey").alias("definition_id"), F.lit("instance_method").alias("kind"), (F.col("p_size") >= 30).alias("test"), v.alias("visibility"))
    return roots.library_surface(nodes)[0]


@query("""SELECT DISTINCT s_nationkey::VARCHAR AS definition_id, count(DISTINCT s_suppkey) AS n_sites FROM supplier GROUP BY 1""")
def sites_of_definitions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("definition_id"), F.col("s_suppkey").alias("site"), "s_acctbal")
    return evaluate.sites_of_definitions(s.filter("s_acctbal > 0"), s).drop("sites")
