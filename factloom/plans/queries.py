"""Registered queries: every operator on the driver's tables, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import blockers, classify, dispatch, evidence, fixpoint, guard, lookup, metrics, runtime, sampling, text
from factloom.plans import analysis_queries, change_queries, coverage_queries, diagnosis_queries, graph_queries, release_queries  # noqa: F401  (register their queries)
from factloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from factloom.sources.facts import snapshot_digest
from factloom.sources.tables import supply_links, supply_nodes, supply_roots, supply_sinks, table

DOMAINS = {"runtime": 3, "test": 4, "external": 5}


EDGES = """edges AS (SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""
ROOTS = """roots AS (SELECT CASE c_nationkey WHEN 3 THEN 'runtime' WHEN 4 THEN 'test' ELSE 'external' END AS domain, 'C' || c_custkey AS node
FROM customer WHERE c_nationkey IN (3, 4, 5))"""
WALK = f"""WITH RECURSIVE {EDGES}, {ROOTS},
walk(domain, node) AS (SELECT domain, node FROM roots UNION SELECT w.domain, e.dst FROM walk w JOIN edges e ON e.src = w.node)"""
NODES = "nodes AS (SELECT 'C' || c_custkey AS node FROM customer UNION ALL SELECT 'O' || o_orderkey FROM orders UNION ALL SELECT 'P' || p_partkey FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier)"
#: Flags of the stand-in graph: urgent orders are blocked, finished ones were observed, and penalties come from other columns.
FLAGS = f"""{WALK}, {NODES},
facts AS (SELECT 'O' || o_orderkey AS node, o_orderpriority = '1-URGENT' AS blocked, o_orderstatus = 'F' AS observed, o_orderpriority = '2-HIGH' AS f1, o_totalprice > 300000 AS f2, o_orderstatus = 'P' AS f3, o_orderpriority = '5-LOW' AS f4 FROM orders),
flags AS (SELECT n.node, coalesce(bool_or(domain = 'runtime'), false) AS runtime, coalesce(bool_or(domain = 'test'), false) AS test, coalesce(bool_or(domain = 'external'), false) AS external,
coalesce(bool_or(blocked), false) AS blocked, coalesce(bool_or(observed), false) AS alive, coalesce(bool_or(f1), false) AS f1, coalesce(bool_or(f2), false) AS f2, coalesce(bool_or(f3), false) AS f3, coalesce(bool_or(f4), false) AS f4
FROM nodes n LEFT JOIN walk w ON w.node = n.node LEFT JOIN facts f ON f.node = n.node GROUP BY n.node),
found AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN test THEN 'test_only_reachable' ELSE 'unreachable' END AS classification FROM flags WHERE NOT runtime AND NOT external AND NOT alive),
summed AS (SELECT *, CASE classification WHEN 'blocked' THEN 0.25::DOUBLE WHEN 'test_only_reachable' THEN 0.55::DOUBLE ELSE 0.62::DOUBLE END
- CASE WHEN f1 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN f2 THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN f3 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN f4 THEN 0.4::DOUBLE ELSE 0 END AS raw FROM found),
scored AS (SELECT *, round(greatest(0.0::DOUBLE, raw), 4) AS score FROM summed),
findings AS (SELECT node, classification, score, CASE WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN blocked THEN 'unknown' WHEN test THEN 'statically_reachable' ELSE 'unreachable_under_model' END AS state,
CASE WHEN classification = 'unreachable' THEN 'review_candidate' ELSE 'diagnostic' END AS actionability, 2 + blocked::INT + f1::INT + f2::INT + f3::INT + f4::INT + (raw < 0)::INT AS n_components FROM scored)"""


def _reached(spark, sf_dir):
    return fixpoint.reach(supply_links(spark, sf_dir), supply_roots(spark, sf_dir, DOMAINS), preds=False)


def _findings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("node", F.concat(F.lit("O"), "o_orderkey"))
    flags = {"is_uncertain": "o_orderpriority = '2-HIGH'", "is_dynamic_owner": "o_totalprice > 300000", "is_generated_accessor": "o_orderstatus = 'P'", "is_implicit": "o_orderpriority = '5-LOW'"}
    nodes = supply_nodes(spark, sf_dir).join(orders.select("node", *[F.expr(v).alias(k) for k, v in flags.items()]), "node", "left")
    nodes = nodes.select("node", *[F.coalesce(k, F.lit(False)).alias(k) for k in flags])
    blocked, observed = orders.filter("o_orderpriority = '1-URGENT'").select("node"), orders.filter("o_orderstatus = 'F'").select("node")
    return classify.findings(classify.flag_nodes(nodes, _reached(spark, sf_dir), blocked, observed))


@query(f"{FLAGS} SELECT node, classification, score, confidence, actionability, state, n_components FROM findings")
def classify_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("node", "classification", "score", "confidence", "actionability", "state", F.size("components").alias("n_components"))


@query(f"{FLAGS} SELECT classification, confidence, count(*) AS n FROM findings GROUP BY ALL")
def finding_counts(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("classification", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FLAGS} SELECT node, score FROM findings WHERE actionability = 'review_candidate' AND confidence IN ('medium', 'high', 'certain')")
def actionable_only(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.filter((F.col("actionability") == "review_candidate") & (scalars.rank_of(F.col("confidence")) >= 2)).select("node", "score")


@query(f"{WALK} SELECT domain, node FROM walk")
def reach_multi_domain(spark, sf_dir):
    return _reached(spark, sf_dir).select("domain", "node")


@query(f"""WITH RECURSIVE {EDGES}, {ROOTS},
walk(node, hops) AS (SELECT node, 0 FROM roots WHERE domain = 'runtime' UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.hops < 9),
best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node)
SELECT b.node, b.hops, min(p.node) AS pred FROM best b LEFT JOIN edges e ON e.dst = b.node LEFT JOIN best p ON p.node = e.src AND p.hops = b.hops - 1 GROUP BY b.node, b.hops""")
def reach_hops(spark, sf_dir):
    reached = fixpoint.reach(supply_links(spark, sf_dir), supply_roots(spark, sf_dir, {"runtime": 3}))
    return reached.select("node", "hops", "pred")


@query(None)
def witness_path(spark, sf_dir):
    reached = fixpoint.reach(supply_links(spark, sf_dir), supply_roots(spark, sf_dir, {"runtime": 3}))
    return fixpoint.witness_paths(reached, reached.select("node")).select("node", F.array_join("path", ">").alias("path"), F.size("path").alias("length"))


@query(f"""WITH RECURSIVE {EDGES}, {NODES},
open AS (SELECT dst AS src, src AS dst FROM edges WHERE dst NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 10)),
walk(node) AS (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION SELECT o.dst FROM walk w JOIN open o ON o.src = w.node)
SELECT node FROM walk""")
def implicit_taint(spark, sf_dir):
    alive = table(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return fixpoint.taint(supply_links(spark, sf_dir), alive, supply_sinks(spark, sf_dir, 3)).select("node")


HIERARCHY = """pairs AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""


@query(f"""WITH {HIERARCHY} SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM pairs
UNION ALL SELECT a.parent, b.child, 2 FROM pairs a JOIN pairs b ON a.child = b.parent""")
def hierarchy_closure(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    pairs = n.select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    pairs = pairs.unionByName(s.select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("S"), "s_suppkey").alias("child")))
    return fixpoint.closure(pairs)


@query(f"""WITH RECURSIVE {EDGES}, undirected AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk(node, hops) AS (SELECT node, 0 FROM (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_nationkey = 3)
UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN undirected e ON e.src = w.node WHERE w.hops < 8) SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def nearest_alive(spark, sf_dir):
    return fixpoint.nearest(supply_links(spark, sf_dir), supply_sinks(spark, sf_dir, 3))


@query("""WITH refs AS (SELECT DISTINCT p_name AS ref FROM part UNION SELECT 'P' || p_partkey FROM part UNION SELECT 'gone' || r_name FROM region),
by_symbol AS (SELECT p_name AS ref, count(*) AS n, min('P' || p_partkey) AS t FROM part GROUP BY 1)
SELECT r.ref, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' WHEN p.p_partkey IS NOT NULL THEN 'exact' ELSE 'missing' END AS status,
coalesce(n, CASE WHEN p.p_partkey IS NOT NULL THEN 1 ELSE 0 END) AS n_targets,
CASE WHEN n = 1 THEN t WHEN n IS NULL AND p.p_partkey IS NOT NULL THEN r.ref END AS target
FROM refs r LEFT JOIN by_symbol b ON b.ref = r.ref LEFT JOIN part p ON 'P' || p.p_partkey = r.ref""")
def definition_lookup_status(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ids = F.concat(F.lit("P"), "p_partkey")
    refs = part.select(F.col("p_name").alias("ref")).union(part.select(ids)).union(table(spark, sf_dir, "region").select(F.concat(F.lit("gone"), "r_name")))
    return lookup.definition_lookup(refs, part.select(ids.alias("definition_id"), F.col("p_name").alias("symbol_id")))


def _customer_orders(spark, sf_dir):
    ev = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("caller_id"), F.concat(F.lit("O"), "o_orderkey").alias("callee_id"), F.col("o_orderkey").cast("string").alias("evidence_id"))
    nodes = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("C"), "c_custkey").alias("definition_id"))
    nodes = nodes.unionByName(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("O"), "o_orderkey").alias("definition_id")))
    return lookup.edges_of(ev, nodes)


KNOWN = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') AND o_orderstatus <> 'P'"


@query(f"SELECT 'C' || o_custkey AS caller_id, 'O' || o_orderkey AS callee_id FROM orders WHERE {KNOWN}")
def edge_materialise(spark, sf_dir):
    return _customer_orders(spark, sf_dir)[0].select("caller_id", "callee_id")


@query(f"SELECT 'C' || o_custkey AS caller_id, 'O' || o_orderkey AS callee_id FROM orders WHERE NOT ({KNOWN})")
def edge_orphans(spark, sf_dir):
    return _customer_orders(spark, sf_dir)[1].select("caller_id", "callee_id")


@query("""WITH refs AS (SELECT s_suppkey AS ref, p_name AS symbol_id, CASE WHEN s_suppkey % 3 > 0 THEN p_brand END AS file, CASE WHEN s_suppkey % 3 = 2 THEN p_size END AS line
FROM supplier JOIN part ON p_partkey = s_suppkey * 3),
hit AS (SELECT r.ref, count(*) AS n, min(p_partkey) AS t FROM refs r JOIN part p ON p.p_name = r.symbol_id AND (r.file IS NULL OR r.file = p.p_brand) AND (r.line IS NULL OR r.line = p.p_size) GROUP BY 1)
SELECT r.ref, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN t END AS target FROM refs r LEFT JOIN hit h ON h.ref = r.ref""")
def runtime_ref_narrow(spark, sf_dir):
    part, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    refs = s.join(part, F.col("p_partkey") == F.col("s_suppkey") * 3).select(
        F.col("s_suppkey").alias("ref"), F.col("p_name").alias("symbol_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("p_brand")).alias("file"), F.when(F.col("s_suppkey") % 3 == 2, F.col("p_size")).alias("line")
    )
    nodes = part.select(F.col("p_partkey").alias("definition_id"), F.col("p_name").alias("symbol_id"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    return lookup.runtime_reference(refs, nodes)


@query("""WITH chains AS (SELECT n_nationkey AS owner, 0 AS pos, n_nationkey AS candidate FROM nation
UNION ALL SELECT a.n_nationkey, 1, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
methods AS (SELECT s_nationkey AS candidate, s_suppkey % 10 AS message, s_suppkey AS definition_id FROM supplier),
sites AS (SELECT c_custkey AS site, c_nationkey AS owner, c_custkey % 10 AS message FROM customer),
ranked AS (SELECT s.site, definition_id, rank() OVER (PARTITION BY s.site ORDER BY pos) AS r FROM sites s JOIN chains c ON c.owner = s.owner JOIN methods m ON m.candidate = c.candidate AND m.message = s.message)
SELECT site, definition_id FROM ranked WHERE r = 1""")
def ordered_lookup_first_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    own = n.select(F.col("n_nationkey").alias("owner"), F.lit(0).alias("pos"), F.col("n_nationkey").alias("candidate"))
    a, b = n.alias("a"), n.alias("b")
    near = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("owner"), F.lit(1).alias("pos"), F.col("b.n_nationkey").alias("candidate"))
    methods = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("candidate"), (F.col("s_suppkey") % 10).alias("message"), F.col("s_suppkey").alias("definition_id"))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 10).alias("message"))
    return lookup.ordered_lookup(sites, own.unionByName(near), methods).select("site", "definition_id")


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias("definition_id"))


@query("SELECT p_name || '/' || p_brand AS name, p_partkey AS definition_id FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_brand) <= 4")
def name_fallback_bounded(spark, sf_dir):
    return lookup.name_fallback(_names(spark, sf_dir), 4)


@query("SELECT p_name || '/' || p_brand AS name, count(*) AS n_definitions, count(*) > 4 AS exceeded FROM part GROUP BY 1")
def ambiguity_exceeded(spark, sf_dir):
    return lookup.ambiguity(_names(spark, sf_dir), 4)


LINE = ["l_orderkey", "l_linenumber"]  # what an evidence id is made of


def _evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return evidence.by_columns(lines, LINE, ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


PAYLOAD = "concat_ws('|', l_partkey, l_suppkey, l_quantity, l_returnflag)"
EVIDENCE_ID = """'evidence:v1:' || sha256('["' || l_orderkey || '","' || l_linenumber || '"]')"""


@query(f"SELECT {EVIDENCE_ID} AS evidence_id, count(DISTINCT {PAYLOAD}) AS n_payloads FROM lineitem GROUP BY 1 HAVING count(DISTINCT {PAYLOAD}) > 1")
def evidence_collisions(spark, sf_dir):
    return evidence.collisions(_evidence(spark, sf_dir), LINE).select(evidence.identity("evidence:v1", LINE).alias("evidence_id"), "n_payloads")


@query(f"SELECT {EVIDENCE_ID} AS evidence_id, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT {PAYLOAD}) = 1")
def evidence_dedupe(spark, sf_dir):
    return evidence.accepted(_evidence(spark, sf_dir), LINE).select(evidence.identity("evidence:v1", LINE).alias("evidence_id"), "l_partkey", "l_suppkey")


@query(f"""WITH bad AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT {PAYLOAD}) > 1)
SELECT l_returnflag AS domain, count(DISTINCT l_orderkey || '|' || l_linenumber) AS n_ids FROM lineitem SEMI JOIN bad USING (l_orderkey, l_linenumber) GROUP BY 1""")
def evidence_collision_blockers(spark, sf_dir):
    return evidence.collision_blockers(_evidence(spark, sf_dir), "l_returnflag", LINE)


@query("""SELECT p AS projection, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem, (VALUES ('conservative'), ('exact'), ('observed')) v(p)
WHERE p = 'conservative' OR (l_returnflag = 'R' AND l_linestatus = 'F') OR (p = 'exact' AND l_returnflag = 'A') GROUP BY 1""")
def evidence_projections(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    grade = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "observed").otherwise("heuristic")
    tags = F.array_compact(F.array(*[F.when(evidence.in_projection(p, grade, F.col("l_linestatus") == "F"), p) for p in ("conservative", "exact", "observed")]))
    return lines.select(F.explode(tags).alias("projection"), "l_quantity").groupBy("projection").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH sets AS (SELECT l_partkey AS site, l_returnflag, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS t FROM lineitem GROUP BY 1, 2)
SELECT site, count(DISTINCT t) AS n_sets FROM sets GROUP BY 1 HAVING count(DISTINCT t) > 1""")
def resolution_conflicts(spark, sf_dir):
    return evidence.conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("producer"), F.col("l_suppkey").alias("target")))


def _blockers(spark):
    rows = [("b1", "message", "red widget", "exact"), ("b2", "owner", "Brand#2", "exact"), ("b3", "namespace", "ECONOMY", "exact"), ("b4", "definition", "P7", "exact"), ("b5", "message", "small *", "glob"), ("b6", "owner", "Brand#1?", "glob"), ("b7", "global", None, "exact")]
    return blockers.listed(spark, [{"blocker_id": b, "kind": "configured", "scope_kind": k, "scope_value": v, "scope_match": m} for b, k, v, m in rows])


@query("""SELECT b AS blocker_id, 'P' || p_partkey AS definition_id FROM part, (VALUES ('b1'), ('b2'), ('b3'), ('b4'), ('b5'), ('b6')) v(b)
WHERE (b = 'b1' AND p_name = 'red widget') OR (b = 'b2' AND p_brand = 'Brand#2') OR (b = 'b3' AND p_type = 'ECONOMY') OR (b = 'b4' AND p_partkey = 7)
OR (b = 'b5' AND p_name LIKE 'small %') OR (b = 'b6' AND p_brand LIKE 'Brand#1_')""")
def blocker_match_scopes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(
        F.concat(F.lit("P"), "p_partkey").alias("definition_id"), F.concat(F.lit("sym"), "p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"),
        F.concat_ws("/", "p_type", "p_brand").alias("file"), blockers.namespaces(F.concat_ws("::", "p_type", "p_brand")).alias("namespaces"),
    )
    return blockers.match(_blockers(spark), nodes)


@query("""WITH bands AS (SELECT p_brand AS file, p_size * 10 AS first, p_size * 10 + 15 AS last, p_partkey AS span FROM part),
hits AS (SELECT event_id, 'Brand#' || (user_id % 25) AS file, floor(value)::INTEGER AS line FROM events WHERE event_type = 'error')
SELECT event_id, span FROM hits h JOIN bands b ON h.file = b.file AND h.line BETWEEN b.first AND b.last""")
def line_interval_join(spark, sf_dir):
    spans = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), (F.col("p_size") * 10).alias("first"), (F.col("p_size") * 10 + 15).alias("last"), F.col("p_partkey").alias("span"))
    hits = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.concat(F.lit("Brand#"), F.col("user_id") % 25).alias("file"), F.floor("value").cast("int").alias("line"))
    return runtime.line_interval_join(hits, spans).select("event_id", "span")


@query("""WITH paths AS (SELECT DISTINCT split_part(split_part(url, '#', 1), '?', 1) AS path FROM pages),
files AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN split_part(split_part(url, '#', 1), '?', 1) ELSE regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^.*/([^/]+/[^/]+)$', '\\1') END AS file FROM pages),
same AS (SELECT file, path FROM files JOIN paths ON path = file OR path = './' || file)
SELECT file, path FROM same UNION ALL SELECT file, path FROM files JOIN paths ON ends_with(path, '/' || file) WHERE file NOT IN (SELECT file FROM same)""")
def coverage_path_match(spark, sf_dir):
    clean = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).alias("path"))
    short = F.regexp_replace("path", "^.*/([^/]+/[^/]+)$", "$1")
    files = clean.select(F.when(F.col("page_id") % 3 == 0, F.col("path")).otherwise(short).alias("file"))
    return runtime.coverage_paths(files, clean.select("path").distinct())


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END = min(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) OVER (PARTITION BY user_id)""")
def structured_over_legacy(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2))
    return runtime.prefer(e, ["user_id"], "p").select("user_id", "event_id", "event_type")


SPLIT = "1998-01-01"


@query(f"SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate >= '{SPLIT}' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderdate < '{SPLIT}' AND b.o_custkey = o.o_custkey AND b.o_orderpriority = o.o_orderpriority)")
def baseline_new_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return guard.new_findings(o.filter(F.col("o_orderdate") >= SPLIT), o.filter(F.col("o_orderdate") < SPLIT), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey")


def _states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    state = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("state"))
    return state(o.filter(F.col("o_orderdate") < SPLIT)), state(o.filter(F.col("o_orderdate") >= SPLIT))


@query(f"""WITH b AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < '{SPLIT}' GROUP BY 1), a AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= '{SPLIT}' GROUP BY 1)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.s AS before_state, a.s AS after_state, CASE WHEN b.s IS NULL THEN 'added' WHEN a.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change
FROM b FULL JOIN a ON a.o_custkey = b.o_custkey""")
def diff_full_outer(spark, sf_dir):
    return guard.changes(*_states(spark, sf_dir), "o_custkey", "state")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def changed_semi_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return guard.touched(table(spark, sf_dir, "lineitem"), urgent, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT *, 'missing_static' AS kind FROM (SELECT * FROM o EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'unobserved' FROM (SELECT * FROM s EXCEPT SELECT * FROM o)""")
def feedback_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return guard.feedback(lines.filter("l_returnflag = 'N'"), lines.filter("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"])


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


RETRIEVAL = """counts AS (SELECT {by} count(*) FILTER (n_chars > 2000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 2000 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 2000 AND quality = 1) AS fn
FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fn), 4) END AS recall FROM counts)"""


@query(f"WITH {RETRIEVAL.format(by='lang,')} SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM pr")
def precision_recall_f1(spark, sf_dir):
    return metrics.retrieval(_labelled(spark, sf_dir), ["lang"], F.col("n_chars") > 2000, F.col("quality") == 1)


@query("""SELECT lang, count(*) FILTER (n_chars > 12000) AS n_labeled, CASE WHEN count(*) FILTER (n_chars > 12000) > 0 THEN round(count(*) FILTER (n_chars > 12000 AND toxic = 1) / count(*) FILTER (n_chars > 12000), 4) END AS precision,
CASE WHEN count(*) FILTER (n_chars > 12000) = 0 THEN 'unlabeled' ELSE 'measured' END AS precision_status FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def precision_nullable(spark, sf_dir):
    return metrics.nullable_precision(_labelled(spark, sf_dir), ["lang"], F.col("n_chars") > 12000, F.col("toxic") == 1)


@query(f"WITH {RETRIEVAL.format(by='lang,')} SELECT round(sum(round(precision, 4)::DECIMAL(18,4)) / count(precision) + 1e-9, 4) AS macro, count(precision) AS n_parts FROM pr")
def macro_average(spark, sf_dir):
    return metrics.macro(metrics.retrieval(_labelled(spark, sf_dir), ["lang"], F.col("n_chars") > 2000, F.col("quality") == 1), "precision")


@query("SELECT lang, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars BETWEEN 500 AND 3000) AS middle, count(*) FILTER (n_chars > 3000) AS long FROM documents GROUP BY lang")
def tool_matrix_pivot(spark, sf_dir):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") <= 3000, "middle").otherwise("long")
    return metrics.tool_matrix(table(spark, sf_dir, "documents").select("lang", size.alias("tool")), "lang", "tool", ["short", "middle", "long"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, min(value) AS low, max(value) AS high, min(value) FILTER (i >= greatest(ceil(n * 50 / 100.0), 1)) AS p50, min(value) FILTER (i >= greatest(ceil(n * 95 / 100.0), 1)) AS p95 FROM r GROUP BY 1""")
def distribution_p95_nearest_rank(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "events"), ["event_type"], "value").drop("mean")


@query("SELECT user_id, event_type, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def map_merge_sum(spark, sf_dir):
    return runtime.merge_counts(table(spark, sf_dir, "events").withColumn("one", F.lit(1)), ["user_id", "event_type"], "one")


@query("""SELECT event_id, user_id, day FROM (SELECT event_id, user_id, cast(ts AS DATE) AS day, max(cast(ts AS DATE)) OVER (PARTITION BY user_id) AS top FROM events) WHERE day = top""")
def latest_run_replaces(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return runtime.latest_run(e, ["user_id"], "day")


@query("""SELECT CASE WHEN bool_or(status = 'P') THEN 'invalid' WHEN bool_or(status = 'O') THEN 'degraded' ELSE 'complete' END AS status, count(*) AS n_reasons FROM (SELECT o_orderstatus AS status FROM orders)""")
def health_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return classify.health(o.select(F.when(F.col("o_orderstatus") == "P", "invalid").when(F.col("o_orderstatus") == "O", "degraded").alias("severity")))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem")
def ordinal_per_key(spark, sf_dir):
    out = sampling.ordinal(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ordinal")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topk_per_definition(spark, sf_dir):
    return sampling.top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 2).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s1:' || doc_id), doc_id) <= 25")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, "s1")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders), p AS (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS s FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o.o_orderkey, p.s AS latest_s FROM o ASOF LEFT JOIN p ON o.o_custkey = p.o_custkey AND o.o_orderdate >= p.o_orderdate""")
def asof_latest_before(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    right = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderstatus").alias("s"))
    return runtime.as_of(o.select("o_orderkey", "o_custkey", "o_orderdate"), right, "o_custkey", "o_orderdate", "o_orderdate", "s").select("o_orderkey", "latest_s")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents), n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark)
SELECT token AS name, count(DISTINCT doc_id) AS n_texts, count(*) AS n_mentions FROM t SEMI JOIN n USING (token) GROUP BY 1""")
def text_token_join(spark, sf_dir):
    names = text.token_counts(table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("token").alias("name"))
    return text.mentioned(names, table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT CASE WHEN regexp_matches(url, '[A-Za-z]+[.#:]{1,2}[a-z_]+') THEN 'qualified' WHEN regexp_matches(url, '[:''\"][a-z_]+') THEN 'symbol' ELSE 'plain' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def text_reference_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.reference_kind("url").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<script>(.*?)</script>')) AS n_regions FROM pages")
def template_regions(spark, sf_dir):
    return text.template_regions(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""SELECT parent, child, count(*) AS n FROM (SELECT event_type AS child, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events) WHERE parent IS NOT NULL GROUP BY ALL""")
def trace_parent_edges(spark, sf_dir):
    return runtime.parent_edges(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), "user_id", ["ts", "event_id"])


@query("SELECT p_partkey, sha256(p_name || ':' || p_brand || ':' || p_size) AS fingerprint FROM part")
def fingerprint_sha256(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("fingerprint"))


@query("""SELECT DISTINCT p_name, lower(regexp_replace(list_reduce(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || b), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part""")
def camel_underscore(spark, sf_dir):
    camel = scalars.camelize(F.regexp_replace("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select("p_name", scalars.underscore(camel).alias("snake")).distinct()


@query("""WITH a AS (SELECT o_orderkey, sha256('unreachable:' || o_orderkey) AS wanted, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 7 AS k, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'invalid' WHEN k = 2 THEN 'fingerprint_required' WHEN k IN (3, 4) THEN 'stale_fingerprint' WHEN d <= DATE '1999-01-01' - 365 THEN 'review_required' ELSE 'active' END AS status FROM a""")
def quarantine_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = scalars.fingerprint(F.lit("unreachable"), F.col("o_orderkey"))
    k = F.col("o_orderkey") % 7
    date = F.concat(F.lit("# quarantine since="), F.date_format("o_orderdate", "yyyy-MM-dd"))
    other = scalars.fingerprint(F.lit("blocked"), F.col("o_orderkey"))
    note = (
        F.when(k == 0, F.lit("# a comment"))
        .when(k == 1, F.lit("# quarantine since=soon"))
        .when(k == 2, date)
        .when(k == 3, F.concat(date, F.lit(" fingerprint="), other))
        .when(k == 4, F.concat(date, F.lit(" fingerprint=short")))
        .when(k == 5, F.concat(date, F.lit(" fingerprint="), wanted))
        .otherwise(F.concat(date, F.lit(" fingerprints="), other, F.lit(","), wanted))
    )
    return orders.select("o_orderkey", scalars.quarantine_status(note, wanted, F.lit("1999-01-01").cast("date"), 365).alias("status"))


@query("SELECT p_partkey FROM part WHERE (p_type || '/' || p_brand) SIMILAR TO '(ECONOMY/.*|STANDARD/Brand#1.?)' AND NOT p_brand = 'Brand#2'")
def report_path_filter(spark, sf_dir):
    path = F.concat_ws("/", "p_type", "p_brand")
    return table(spark, sf_dir, "part").filter(scalars.path_filter(path, ["ECONOMY/*", "STANDARD/Brand#1", "STANDARD/Brand#1?"], ["**/Brand#2"])).select("p_partkey")


@query("""SELECT 'union' AS op, n FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'intersect', n FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'except', n FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "n")
    return tag("union", c.union(s).distinct()).unionByName(tag("intersect", c.intersect(s))).unionByName(tag("except", c.subtract(s)))


@query(None)
def snapshot(spark, sf_dir):
    return snapshot_digest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("""SELECT c_custkey AS site, s_suppkey AS definition_id FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
JOIN supplier ON s_nationkey = b.n_nationkey AND s_suppkey % 10 = c_custkey % 10""")
def super_lookup_suffix(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = n.select(F.col("n_nationkey").alias("owner"), F.lit(0).alias("pos"), F.col("n_nationkey").alias("candidate"))
    a, b = n.alias("a"), n.alias("b")
    near = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("owner"), F.lit(1).alias("pos"), F.col("b.n_nationkey").alias("candidate"))
    methods = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("candidate"), (F.col("s_suppkey") % 10).alias("message"), F.col("s_suppkey").alias("definition_id"))
    sites = c.select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("owner"), F.col("c_nationkey").alias("current"), (F.col("c_custkey") % 10).alias("message"))
    return dispatch.super_lookup(sites, own.unionByName(near), methods).select("site", "definition_id")


@query("""WITH b AS (SELECT o_orderkey AS idx, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
SELECT idx, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN idx = min(idx) OVER (PARTITION BY b.o_custkey) THEN 'matched' ELSE 'taken' END AS outcome, CASE WHEN n = 1 THEN f END AS finding
FROM b LEFT JOIN c ON c.o_custkey = b.o_custkey""")
def baseline_claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    baseline = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("idx"), "o_custkey")
    return guard.claims(baseline, o.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("finding"), "o_custkey"), ["o_custkey"])


@query(f"""WITH b AS (SELECT o_custkey, CASE WHEN max(o_orderstatus) = 'P' THEN 'public' ELSE 'private' END AS s FROM orders WHERE o_orderdate < '{SPLIT}' GROUP BY 1),
a AS (SELECT o_custkey, CASE WHEN max(o_orderstatus) = 'P' THEN 'public' ELSE 'private' END AS s FROM orders WHERE o_orderdate >= '{SPLIT}' GROUP BY 1)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.s AS before_state, a.s AS after_state, CASE WHEN b.s IS NULL THEN 'added' WHEN a.s IS NULL THEN 'removed' ELSE 'visibility_changed' END AS change
FROM b FULL JOIN a ON a.o_custkey = b.o_custkey WHERE b.s IS DISTINCT FROM a.s AND (b.s = 'public' OR a.s = 'public')""")
def public_surface_changes(spark, sf_dir):
    named = [s.withColumn("state", F.when(F.col("state") == "P", "public").otherwise("private")) for s in _states(spark, sf_dir)]
    return guard.surface_changes(*named, "o_custkey", "state")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 300""")
def review_queue_topk(spark, sf_dir):
    levels = {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["F", "P"]}
    return sampling.review_queue(table(spark, sf_dir, "orders"), levels, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("""WITH c AS (SELECT p_partkey, [p_size % 3, p_partkey % 2, CASE WHEN p_size > 20 THEN p_size END] AS v FROM part), x AS (SELECT p_partkey, v, unnest(v) AS n, generate_subscripts(v, 1) AS i FROM c)
SELECT DISTINCT p_partkey, CASE WHEN v[1] > 0 AND v[2] > 0 AND coalesce(v[3] > 0, false) THEN n ELSE i END AS line FROM x WHERE n > 0""")
def coverage_executed_lines(spark, sf_dir):
    counts = F.array((F.col("p_size") % 3).cast("long"), F.col("p_partkey") % 2, F.when(F.col("p_size") > 20, F.col("p_size").cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(runtime.executed_lines(counts)).alias("line"))


@query("""WITH m AS (SELECT event_type, avg(value) AS mean, max(value) AS high FROM events GROUP BY 1), v AS (SELECT event_type, 'mean' AS metric, mean AS value, 100.0::DOUBLE AS cap FROM m UNION ALL SELECT event_type, 'high', high, 500.0::DOUBLE FROM m)
SELECT event_type, metric, round(value, 6) AS value, cap, coalesce(value <= cap, false) AS passed FROM v""")
def performance_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    measured = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("high"))
    limits = e.select("event_type").distinct().withColumn("mean", F.lit(100.0)).withColumn("high", F.lit(500.0))
    return metrics.performance_gate(measured, limits, "event_type", ["mean", "high"]).withColumn("value", F.round("value", 6))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND (l_linestatus = 'F' AND l_linenumber % 3 > 0) GROUP BY ALL""")
def private_target_rejects(spark, sf_dir):
    out = dispatch.private_rejected(
        F.when(F.col("l_returnflag") == "R", "private").otherwise("public"), F.when(F.col("l_linestatus") == "F", "constant").otherwise("self"),
        F.when(F.col("l_linenumber") % 3 == 0, "send"), F.lit(None).cast("boolean"),
    )
    return table(spark, sf_dir, "lineitem").filter(out).groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
