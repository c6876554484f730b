"""Registered queries of differences between two graphs and two reports, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import diff, incremental
from factloom.plans.registry import query
from factloom.sources.tables import supply_links, supply_roots, table

SPLIT = "1998-01-01"

SUPPLY = """WITH RECURSIVE lines AS (SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, l_linenumber AS n FROM lineitem),
rest AS (SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
e1 AS (SELECT src, dst FROM lines WHERE n <> 1 UNION SELECT src, dst FROM rest), e2 AS (SELECT src, dst FROM lines WHERE n <> 2 UNION SELECT src, dst FROM rest),
r1 AS (SELECT CASE c_nationkey WHEN 3 THEN 'runtime' ELSE 'test' END AS domain, 'C' || c_custkey AS node FROM customer WHERE c_nationkey IN (3, 4)), r2 AS (SELECT CASE c_nationkey WHEN 3 THEN 'runtime' ELSE 'test' END AS domain, 'C' || c_custkey AS node FROM customer WHERE c_nationkey IN (3, 5)),
w1(domain, node) AS (SELECT domain, node FROM r1 UNION SELECT w.domain, e.dst FROM w1 w JOIN e1 e ON e.src = w.node), w2(domain, node) AS (SELECT domain, node FROM r2 UNION SELECT w.domain, e.dst FROM w2 w JOIN e2 e ON e.src = w.node)"""


@query(f"{SUPPLY} SELECT coalesce(a.domain, b.domain) AS domain, coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'lost' ELSE 'gained' END AS change FROM w1 a FULL JOIN w2 b ON a.domain = b.domain AND a.node = b.node WHERE a.node IS NULL OR b.node IS NULL")
def reach_changes(spark, sf_dir):
    """Orders lose their second lines and get their first ones, and tests start from another nation: reachability follows the change."""
    has = lambda n: F.coalesce(F.col("l_linenumber") != n, F.lit(False))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), has(1).alias("before"), has(2).alias("after"))
    rest = supply_links(spark, sf_dir).filter("src not like 'O%'").select("src", "dst", F.lit(True).alias("before"), F.lit(True).alias("after"))
    before, after = (supply_roots(spark, sf_dir, {"runtime": 3, "test": n}) for n in (4, 5))
    return incremental.reach_changes(lines.unionByName(rest), before, after)


def _report(spark, sf_dir, head: bool) -> diff.Report:
    text = lambda c: F.concat(F.lit("c"), (F.col(c) if isinstance(c, str) else c).cast("string"))
    o, c, key = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = o.filter(F.col("o_orderdate") >= SPLIT if head else F.col("o_orderdate") < SPLIT)
    kind = F.when(F.max("o_orderstatus") == "F", "unreachable").when(F.max("o_orderstatus") == "O", "test_only_reachable").otherwise("blocked")
    findings = own.groupBy(text("o_custkey").alias("definition_id")).agg(kind.alias("classification"), F.lit(None).cast("string").alias("actionability"), F.lit(0).alias("n_blockers"))
    visibility = F.when(key % (3 if head else 2) == 0, "public").when(key % 5 == 0, "protected").otherwise("private")
    nodes = c.select(text(key).alias("definition_id"), F.col("c_name").alias("symbol_id"), visibility.alias("visibility"))
    edges = o.filter(F.col("o_orderkey") % 20 != (1 if head else 0)).select(text("o_custkey").alias("caller_id"), text(F.col("o_orderkey") % 1000).alias("callee_id"), F.concat(F.lit("o"), "o_orderkey").alias("call_site_id"), F.lit(1).alias("n_evidence"))
    roots = c.filter("c_nationkey = 3" + (" and c_custkey % 10 <> 0" if head else "")).select(text(key).alias("definition_id"))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    resolutions = own.select(text("o_custkey").alias("call_site_id"), status.alias("status"), F.col("o_orderkey").alias("seq"))
    units = c.filter(f"c_nationkey in ({'7, 8' if head else '7, 9'})").select(text(key).alias("unit"))
    return diff.Report(findings, nodes, edges, roots, resolutions, units, "/app", "abc", "complete" if head else "degraded", "stale" if head else "match")


REPORTS = f"""WITH RECURSIVE f AS (SELECT 'c' || o_custkey AS id, o_orderdate >= '{SPLIT}' AS head, max(o_orderstatus) AS s FROM orders GROUP BY ALL), b AS (SELECT id, s FROM f WHERE NOT head), h AS (SELECT id, s FROM f WHERE head),
e AS (SELECT 'c' || o_custkey AS src, 'c' || o_orderkey % 1000 AS dst, 'o' || o_orderkey AS site, o_orderkey % 20 <> 0 AS b, o_orderkey % 20 <> 1 AS h FROM orders),
walk(node) AS (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey % 10 <> 0 UNION SELECT e.dst FROM walk w JOIN e ON e.src = w.node WHERE e.h),
j AS (SELECT coalesce(b.id, h.id) AS id, b.s AS b, h.s AS h FROM b FULL JOIN h ON h.id = b.id),
r AS (SELECT 'c' || o_custkey AS id, o_orderdate >= '{SPLIT}' AS head, arg_max(CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'unknown' END, o_orderkey) AS st FROM orders GROUP BY ALL),
v AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'public ' || c_name WHEN c_custkey % 5 = 0 THEN 'protected ' || c_name END AS b, CASE WHEN c_custkey % 3 = 0 THEN 'public ' || c_name WHEN c_custkey % 5 = 0 THEN 'protected ' || c_name END AS h FROM customer),
changes AS (SELECT 'newly_unreachable' AS change, id AS subject, NULL AS before, NULL AS after FROM j WHERE h = 'F' AND b IS DISTINCT FROM 'F'
UNION ALL SELECT 'newly_reachable', id, NULL, NULL FROM j WHERE b = 'F' AND h IS NULL AND id IN (SELECT node FROM walk) AND id IN (SELECT id FROM v)
UNION ALL SELECT 'newly_blocked', id, NULL, NULL FROM j WHERE h = 'P' AND b IS DISTINCT FROM 'P' UNION ALL SELECT 'blocker_removed', id, NULL, NULL FROM j WHERE b = 'P' AND h IS DISTINCT FROM 'P'
UNION ALL SELECT 'entry_point_removed', 'c' || c_custkey, NULL, NULL FROM customer WHERE c_nationkey = 3 AND c_custkey % 10 = 0 UNION ALL SELECT 'load_unit_unrooted', 'c' || c_custkey, NULL, NULL FROM customer WHERE c_nationkey = 8
UNION ALL SELECT 'dispatch_became_partial', x.id, x.st, y.st FROM r x JOIN r y ON y.id = x.id AND y.head AND NOT x.head WHERE x.st = 'complete' AND y.st <> 'complete'
UNION ALL SELECT CASE WHEN b IS NULL THEN 'public_surface_added' WHEN h IS NULL THEN 'public_surface_removed' ELSE 'public_surface_visibility_changed' END, id, b, h FROM v WHERE b IS DISTINCT FROM h
UNION ALL SELECT 'analysis_health_changed', 'report', 'degraded', 'complete' UNION ALL SELECT 'runtime_evidence_invalidated', 'report', 'match', 'stale')"""


@query(f"{REPORTS} SELECT * FROM changes")
def report_changes(spark, sf_dir):
    return diff.compare(_report(spark, sf_dir, False), _report(spark, sf_dir, True))


@query(
    f"""{REPORTS}, t AS (SELECT subject AS id FROM changes WHERE change = 'newly_unreachable'), k AS (SELECT DISTINCT dst, src, site, b, h FROM e)
SELECT id AS definition_id, count(*) FILTER (b)::INTEGER AS n_base, count(*) FILTER (h)::INTEGER AS n_head, count(*) FILTER (b AND NOT h)::INTEGER AS n_removed, coalesce(max(src || ' ' || site) FILTER (h), max(src || ' ' || site) FILTER (b)) AS last_edge FROM t LEFT JOIN k ON dst = id GROUP BY id"""
)
def change_witnesses(spark, sf_dir):
    base, head = _report(spark, sf_dir, False), _report(spark, sf_dir, True)
    told = diff.witnesses(diff.compare(base, head), base, head)
    total = lambda c: F.coalesce(F.col(f"{c}.total"), F.lit(0))
    last = F.when(F.col("last_incoming").isNotNull(), F.concat_ws(" ", "last_incoming.caller_id", "last_incoming.call_site_id"))
    return told.select("definition_id", total("base_incoming").alias("n_base"), total("head_incoming").alias("n_head"), total("removed_incoming").alias("n_removed"), last.alias("last_edge"))
