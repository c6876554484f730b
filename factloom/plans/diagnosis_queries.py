"""Registered queries of runtime imports, diagnostics, text barriers, rules and candidate metrics, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.scalars import rank_of
from factloom.operators import barrier, diagnose, evaluate, evidence, fixpoint, observe, rules
from factloom.operators.common import dealt
from factloom.plans.registry import query
from factloom.sources.tables import table


def _text(prefix: str, col):
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


@query("SELECT l_orderkey AS run, 'lib/o' || l_orderkey || '.rb' AS path, l_linenumber::INTEGER AS line FROM lineitem GROUP BY ALL HAVING trunc(max(l_quantity))::BIGINT % 2 = 1")
def coverage_payloads(spark, sf_dir):
    """Every order is a payload of one of four shapes."""
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), (F.col("l_quantity").cast("long") % 2).cast("string"))))
    one = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    lines = one.groupBy(F.col("l_orderkey").alias("run")).agg(counts.alias("c"))
    path = F.concat(F.lit("lib/o"), F.col("run"), F.lit(".rb"))
    flat, deep = F.to_json(F.create_map(path, F.col("c"))), F.to_json(F.create_map(path, F.create_map(F.lit("lines"), F.col("c"))))
    wrap = lambda key, j: F.concat(F.lit(f'{{"{key}":'), j, F.lit("}"))
    shape = F.col("run") % 4
    payload = F.when(shape == 0, wrap("files", flat)).when(shape == 1, wrap("coverage", deep)).when(shape == 2, flat).otherwise(wrap("production", wrap("files", deep)))
    return observe.coverage_files(lines.select("run", payload.alias("payload")))


RUNTIME = """WITH nodes AS (SELECT 'P' || p_partkey AS id, 'T' || p_partkey % 37 AS sym, 'f' || p_partkey % 5 AS file, p_size::INTEGER AS line FROM part),
refs AS (SELECT c_custkey AS ref, c_custkey % 5 AS k, 'P' || (c_custkey % 100 + 1) AS id, 'T' || (c_custkey % 100 + 1) % 37 AS own, 'T' || c_custkey % 41 AS sym, 'f' || c_custkey % 5 AS file FROM customer),
hits AS (SELECT ref, 'exact' AS way, n.id FROM refs r JOIN nodes n ON n.id = r.id AND k IN (1, 2) UNION ALL SELECT ref, 'symbol', n.id FROM refs r JOIN nodes n ON k IN (0, 4) AND n.sym = r.sym AND (k = 0 OR n.file = r.file)),
counted AS (SELECT ref, way, count(*) AS n FROM hits GROUP BY ALL),
resolved AS (SELECT r.ref, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.way = 'exact' THEN 'exact' WHEN c.n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, h.id AS definition_id FROM refs r LEFT JOIN counted c USING (ref) LEFT JOIN hits h USING (ref))"""


def _references(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(_text("P", "p_partkey").alias("definition_id"), _text("T", F.col("p_partkey") % 37).alias("symbol_id"), _text("f", F.col("p_partkey") % 5).alias("file"), F.col("p_size").cast("int").alias("line"))
    key = F.col("c_custkey")
    k, at, sym = key % 5, _text("P", key % 100 + 1), _text("T", key % 41)
    refs = table(spark, sf_dir, "customer").select(
        key.alias("ref"), F.when(k == 0, sym).when(k == 1, at).alias("identifier"), F.when(k == 2, at).when(k == 3, F.lit("nowhere")).alias("definition_id"), F.when(k == 2, _text("T", (key % 100 + 1) % 37)).when(k >= 3, sym).alias("symbol_id"),
        F.when(k == 4, _text("f", key % 5)).alias("file"), F.lit(None).cast("int").alias("line"),
    )
    return refs, nodes


@query(f"{RUNTIME} SELECT ref, status, definition_id FROM resolved")
def runtime_resolution(spark, sf_dir):
    return observe.resolve(*_references(spark, sf_dir))


OBSERVED = f"""{RUNTIME}, ends AS (SELECT ref, min(status) AS status, min(definition_id) AS id FROM resolved GROUP BY ref),
edges AS (SELECT o_orderkey AS edge, a.status IN ('exact', 'unique') AND b.status IN ('exact', 'unique') AS both_, a.id AS x, b.id AS y FROM orders JOIN ends a ON a.ref = o_custkey JOIN ends b ON b.ref = o_orderkey % 150),
matched AS (SELECT edge, CASE WHEN both_ THEN x END AS caller_id, CASE WHEN both_ THEN y END AS callee_id, CASE WHEN both_ THEN 'matched' WHEN x IS NULL AND y IS NULL THEN 'unmatched' ELSE 'partially_matched' END AS match FROM edges)"""


def _observed(spark, sf_dir):
    resolved = observe.resolve_ends(*_references(spark, sf_dir))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 150).alias("callee"))
    return resolved, observe.observed_edges(calls, resolved)


@query(f"{OBSERVED} SELECT * FROM matched")
def observed_edges(spark, sf_dir):
    return _observed(spark, sf_dir)[1]


@query(
    f"""{OBSERVED} SELECT 'edges' AS kind, count(*) AS attempted, count(*) FILTER (match = 'matched') AS matched, count(*) FILTER (match = 'partially_matched') AS partially_matched, count(*) FILTER (match = 'unmatched') AS unmatched FROM matched
UNION ALL SELECT 'nodes', count(*), count(*) FILTER (status IN ('exact', 'unique')), count(*) FILTER (status = 'ambiguous'), count(*) FILTER (status = 'missing') FROM (SELECT DISTINCT ref, status FROM resolved)"""
)
def runtime_match_counts(spark, sf_dir):
    return observe.match_counts(*_observed(spark, sf_dir))


PLACES = """WITH up AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
hit AS (SELECT DISTINCT c.c_nationkey AS n, n_regionkey AS r, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 9 THEN 'runtime' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey < 12 THEN 'external' WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 18 THEN 'test' END AS d FROM customer c JOIN nation ON n_nationkey = c_nationkey)"""


def _places(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = customer.select(_text("C", "c_custkey").alias("src"), _text("N", "c_nationkey").alias("dst")).unionByName(nation.select(_text("N", "n_nationkey").alias("src"), _text("R", "n_regionkey").alias("dst"))).distinct()
    at = lambda segment, n, d: F.when((F.col("c_mktsegment") == segment) & (F.col("c_nationkey") < n), d)
    domain = F.coalesce(at("BUILDING", 9, "runtime"), at("MACHINERY", 12, "external"), at("FURNITURE", 18, "test"))
    roots = customer.select(domain.alias("domain"), _text("C", "c_custkey").alias("node")).filter("domain is not null")
    return edges, roots, nation


@query(
    f"""{PLACES}, flags AS (SELECT 'N' || n AS id, bool_or(d = 'runtime') AS a, bool_or(d = 'external') AS b, bool_or(d = 'test') AS c FROM hit GROUP BY 1 UNION ALL SELECT 'R' || r, bool_or(d = 'runtime'), bool_or(d = 'external'), bool_or(d = 'test') FROM hit GROUP BY 1),
asked AS (SELECT 'N' || n_nationkey AS id, n_nationkey % 4 = 0 AS held FROM nation UNION ALL SELECT 'R' || r_regionkey, false FROM region)
SELECT id AS definition_id, CASE WHEN a OR b THEN 'alive' WHEN held THEN 'blocked' WHEN c THEN 'alive' ELSE 'dead' END AS status, CASE WHEN a THEN 'runtime' WHEN b THEN 'external' WHEN held THEN NULL WHEN c THEN 'test' END AS kind,
CASE WHEN a OR b OR (c AND NOT held) THEN CASE WHEN id[1] = 'N' THEN 2 ELSE 3 END ELSE NULL END AS hops FROM asked LEFT JOIN flags USING (id)"""
)
def why_nodes(spark, sf_dir):
    edges, roots, nation = _places(spark, sf_dir)
    nodes = nation.select(_text("N", "n_nationkey").alias("definition_id")).unionByName(table(spark, sf_dir, "region").select(_text("R", "r_regionkey").alias("definition_id")))
    told = diagnose.why(nodes, fixpoint.reach(edges, roots), nation.filter("n_nationkey % 4 = 0").select(_text("N", "n_nationkey").alias("definition_id")))
    return told.select("definition_id", "status", "kind", F.array_size("path").alias("hops"))


@query(
    """WITH alive AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation WHERE n_nationkey % 3 = 0)
SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS alive, 'runtime' AS kind, 1 AS distance FROM customer WHERE c_nationkey % 3 = 0
UNION ALL SELECT 'R' || r, min('N' || n), 'runtime', 1 FROM alive GROUP BY r
UNION ALL SELECT 'N' || n_nationkey, (SELECT min('N' || n) FROM alive WHERE r = n_regionkey), 'runtime', 2 FROM nation WHERE n_nationkey % 3 > 0 AND n_regionkey IN (SELECT r FROM alive)
UNION ALL SELECT 'C' || c_custkey, (SELECT min('N' || n) FROM alive WHERE r = n_regionkey), 'runtime', 3 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 3 > 0 AND n_regionkey IN (SELECT r FROM alive)"""
)
def nearest_alive_nodes(spark, sf_dir):
    edges, _, nation = _places(spark, sf_dir)
    alive = nation.filter("n_nationkey % 3 = 0").select(_text("N", "n_nationkey").alias("node"), F.lit("runtime").alias("kind"))
    return diagnose.nearest_alive(edges, alive, edges.select(F.explode(F.array("src", "dst")).alias("node")))


SITES = "WITH sites AS (SELECT c_custkey AS site, 'm' || c_custkey % 40 AS message, c_custkey % 7 AS t FROM customer), nodes AS (SELECT 'S' || s_suppkey AS id, 'm' || s_suppkey % 50 AS name, s_suppkey AS k FROM supplier)"


def _sites(spark, sf_dir):
    key = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "supplier").select(
        _text("S", key).alias("definition_id"), _text("m", key % 50).alias("name"), F.when(key % 3 == 0, "unreachable").when(key % 3 == 1, "blocked").alias("classification"), (key % 5 == 0).alias("runtime"), F.lit(False).alias("external"), (key % 5 == 1).alias("test"),
        F.when(key % 2 == 0, "public").otherwise("private").alias("visibility"), F.lit("def").alias("defined_via"), F.lit(1).alias("n_same"), F.lit("A").alias("owner"), F.lit(False).alias("dynamic_owner"), F.lit(False).alias("test_definition"),
    )
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    sites = customer.select(key.alias("call_site_id"), _text("m", key % 40).alias("message"))
    status = F.when(key % 3 == 0, "complete").when(key % 3 == 1, "partial")
    resolutions = customer.select(key.alias("call_site_id"), F.lit("p").alias("producer"), status.alias("status")).filter("status is not null")
    targets = customer.filter("c_custkey % 7 = 1").select(key.alias("call_site_id"), _text("S", key % 11).alias("definition_id"))
    return nodes, sites, resolutions, targets


@query(
    f"""{SITES}, seen AS (SELECT id, site FROM nodes JOIN sites ON message = name UNION SELECT id, site FROM nodes JOIN sites ON t = 1 AND id = 'S' || site % 11), counted AS (SELECT id, count(*) AS n, count(*) FILTER (site % 3 = 0) AS c, count(*) FILTER (site % 3 = 1) AS p, count(*) FILTER (site % 3 = 2) AS u FROM seen GROUP BY id)
SELECT id AS definition_id, CASE WHEN k % 3 = 0 THEN 'candidate' WHEN k % 3 = 1 THEN 'blocked' WHEN k % 5 = 0 THEN 'runtime_reachable' WHEN k % 5 = 1 THEN 'test_only' ELSE 'not_classified' END AS state,
CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'review' ELSE 'verify' END WHEN k % 3 = 1 THEN 'review' WHEN k % 5 = 0 THEN 'keep' WHEN k % 5 = 1 THEN 'observe' ELSE 'verify' END AS action, coalesce(n, 0) AS n_sites, coalesce(c, 0) AS complete, coalesce(p, 0) AS partial, coalesce(u, 0) AS unrecorded FROM nodes LEFT JOIN counted USING (id)"""
)
def why_not_states(spark, sf_dir):
    nodes, sites, resolutions, targets = _sites(spark, sf_dir)
    none = nodes.limit(0).select(F.lit(0).cast("long").alias("call_site_id"), "definition_id", F.col("name").alias("kind"), F.col("name").alias("reason"))
    told = diagnose.why_not(nodes, sites, resolutions, targets, none, none)
    return told.select("definition_id", "state", "action", "n_sites", *[F.col(f"resolution_status.{s}").alias(s) for s in ("complete", "partial", "unrecorded")])


@query(
    """WITH res AS (SELECT o_orderkey AS site, o_custkey % 200 AS a, o_orderkey % 13 AS b FROM orders), sites AS (SELECT l_orderkey AS site, count(*) AS n, min(l_linenumber) AS caller FROM lineitem GROUP BY 1),
aims AS (SELECT site, a AS t FROM res UNION SELECT site, b FROM res), known AS (SELECT c_custkey AS k FROM customer)
SELECT site AS call_site_id, CASE WHEN n IS NULL THEN 'unknown_call_site' ELSE 'ambiguous_call_site' END AS issue, NULL::BIGINT AS definition_id FROM res LEFT JOIN sites USING (site) WHERE n IS NULL OR n > 1
UNION ALL SELECT site, CASE WHEN t NOT IN (SELECT k FROM known) THEN 'unknown_target_definition' ELSE 'missing_target_edge' END, t FROM aims LEFT JOIN sites USING (site) WHERE t NOT IN (SELECT k FROM known) OR (n = 1 AND NOT (caller % 2 = t % 2))"""
)
def resolution_issues(spark, sf_dir):
    res = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_site_id"), F.lit("p").alias("producer"), F.array(F.col("o_custkey") % 200, F.col("o_orderkey") % 13).alias("target_definition_ids"))
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_site_id"), F.col("l_linenumber").cast("long").alias("caller_id"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("definition_id"))
    callers = sites.select("caller_id").distinct()
    edges = nodes.select((F.col("definition_id") % 2).alias("_k"), F.col("definition_id").alias("callee_id")).join(callers.withColumn("_k", F.col("caller_id") % 2), "_k").select("caller_id", "callee_id")
    return diagnose.resolution_issues(res, sites, nodes, edges).drop("producer")


@query("SELECT page_id, len(html) - coalesce(list_sum(list_transform(regexp_extract_all(html, '<!--.*?-->|/\\*.*?\\*/', 0, 's'), lambda x: len(regexp_replace(x, '[\\n]', '', 'g')))), 0)::BIGINT AS n_kept FROM pages")
def comment_blanks(spark, sf_dir):
    """Characters outside of block comments, by comparing a page with its blanked text: what was blanked is as long."""
    p = table(spark, sf_dir, "pages").withColumn("b", barrier.blank_comments(F.col("html")))
    inside = F.aggregate(F.regexp_extract_all("html", F.lit(f"({barrier.BLOCK})"), F.lit(1)), F.lit(0), lambda n, c: n + F.length(F.regexp_replace(c, "[\n]", "")))
    return p.select("page_id", (F.length("b") - inside).cast("long").alias("n_kept"))


WORDS = "WITH lines AS (SELECT 'd' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)"


@query(
    f"""{WORDS}, names AS (SELECT unnest(['and', 'the', 'pour', 'keit', 'reference']) AS name), found AS (SELECT path, n, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS token, line FROM lines)
SELECT name AS definition_id, path, n AS line FROM found JOIN names ON name = token"""
)
def barrier_lines(spark, sf_dir):
    """Five names as tokens of all documents' lines."""
    names = spark.createDataFrame([(x,) for x in ("and", "the", "pour", "keit", "reference")], "name string")
    nodes = names.select(F.col("name").alias("definition_id"), "name", F.lit(None).cast("string").alias("owner"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return barrier.matches(files, nodes, limit=2**31 - 1).select("definition_id", "path", "line")


@query(
    """SELECT 'C' || c_custkey AS definition_id, CASE WHEN c_custkey % 6 = 0 THEN 'hook' WHEN c_custkey % 6 = 1 THEN 'protocol' WHEN c_custkey % 6 IN (2, 3) AND n_regionkey = 1 THEN 'callback' ELSE 'any' END AS reason FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_custkey % 6 < 3 AND (c_custkey % 6 < 2 OR n_regionkey = 1) OR c_custkey % 6 = 3"""
)
def implicit_callers(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("included", "to_s", "on_send", "on_any", "pay", "post")]), (key % 6 + 1).cast("int"))
    nodes = table(spark, sf_dir, "customer").select(_text("C", key).alias("definition_id"), name.alias("name"), _text("N", "c_nationkey").alias("owner"))
    reach = table(spark, sf_dir, "nation").select(_text("R", "n_regionkey").alias("ancestor"), _text("N", "n_nationkey").alias("owner"))
    return rules.implicit_callers(nodes, [("^on_", ["R1"], "callback"), ("^on_any$", [], "any")], reach)


@query("SELECT 'C' || c_custkey AS definition_id, CASE WHEN c_nationkey < 10 AND c_custkey % 3 = 0 THEN 'owner' ELSE 'region' END AS rule_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE (c_nationkey < 10 AND c_custkey % 3 = 0) OR n_regionkey = 2")
def convention_hits(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(_text("C", "c_custkey").alias("definition_id"), F.when(F.col("c_custkey") % 3 == 0, "perform").otherwise("other").alias("name"), _text("N", "c_nationkey").alias("owner"))
    up = table(spark, sf_dir, "nation").select(_text("N", "n_nationkey").alias("owner"), F.concat(F.lit("R"), "n_regionkey", F.lit("::Base")).alias("candidate"))
    listed = [{"id": "off", "owners": ["*"], "frameworks": ["none"]}, {"id": "owner", "methods": ["perform"], "owners": ["N?"], "frameworks": ["rails"]}, {"id": "region", "ancestors": ["R2"]}]
    return rules.convention_hits(nodes, listed, up, ["rails"])


LOADS = "refs AS (SELECT c_custkey AS site, c_custkey % 3 AS k, c_custkey % 1250 AS n, 'm' || c_custkey AS caller, c_custkey % 7 = 0 AS test, c_nationkey FROM customer)"


def _loads(spark, sf_dir):
    """References of all customers to suppliers as files: a third each by folder, by load path and unknown; every fourth file is a test's."""
    key = F.col("c_custkey")
    k = key % 3
    path = F.when(k == 0, F.concat(F.lit("../n/./s"), key % 1250)).otherwise(F.concat(F.lit("n/s"), key % 1250, F.lit(".rb")))
    refs = table(spark, sf_dir, "customer").select(
        key.alias("site"), _text("m", key).alias("caller_id"), F.lit("lib/m/x.rb").alias("file"), (key % 7 == 0).alias("test"), F.when(k == 0, "require_relative").otherwise("require").alias("kind"), path.alias("path"), (k < 2).alias("literal")
    )
    roots = table(spark, sf_dir, "supplier").select(F.concat(F.lit("lib/n/s"), "s_suppkey", F.lit(".rb")).alias("file"), _text("S", "s_suppkey").alias("definition_id"), (F.col("s_suppkey") % 4 == 0).alias("test"))
    return rules.load_edges(refs, roots)


@query(
    f"""WITH {LOADS} SELECT site, caller AS caller_id, 'S' || s_suppkey AS target, CASE k WHEN 0 THEN 'require_relative' ELSE 'require_lib_path' END AS strategy FROM refs JOIN supplier ON s_suppkey = n WHERE k < 2
UNION ALL SELECT site, caller, CASE WHEN test THEN 'load:test' ELSE 'load:runtime' END, 'dynamic_conservative' FROM refs WHERE k = 2"""
)
def load_edges(spark, sf_dir):
    return _loads(spark, sf_dir).edges


@query("SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'load:test' ELSE 'load:runtime' END AS src, 'S' || s_suppkey AS dst FROM supplier UNION ALL SELECT 'load:test', 'load:runtime'")
def load_hubs(spark, sf_dir):
    return _loads(spark, sf_dir).hubs


@query(
    f"""WITH {LOADS}, pairs AS (SELECT caller, s_suppkey FROM refs JOIN supplier ON s_suppkey = n WHERE k < 2 UNION SELECT caller, s_suppkey FROM refs, supplier WHERE k = 2 AND (test OR s_suppkey % 4 > 0))
SELECT DISTINCT c_nationkey::VARCHAR AS domain, 'S' || s_suppkey AS node FROM pairs JOIN refs USING (caller)"""
)
def load_reach(spark, sf_dir):
    """The files that each nation's customers may load: reachability over hubs beside all pairs in SQL."""
    loads = _loads(spark, sf_dir)
    roots = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("domain"), _text("m", "c_custkey").alias("node"))
    return fixpoint.reach(loads.graph(), roots).filter("node like 'S%'").select("domain", "node")


@query(f"WITH {LOADS} SELECT 'load:' || caller AS blocker_id, caller AS scope_value, 'require path is not a static string or symbol' AS reason, count(*) AS n_sites FROM refs WHERE k = 2 GROUP BY caller")
def load_blockers(spark, sf_dir):
    return _loads(spark, sf_dir).blockers.select("blocker_id", "scope_value", "reason", "n_sites")


@query(f"WITH {LOADS} SELECT site FROM refs WHERE k < 2 AND n NOT IN (SELECT s_suppkey FROM supplier)")
def load_unresolved(spark, sf_dir):
    return _loads(spark, sf_dir).unresolved


METRICS = """WITH sel AS (SELECT o_orderpriority AS corpus, o_orderkey AS c, CASE o_orderkey % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'alive' WHEN 2 THEN 'external' WHEN 3 THEN 'unsure' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS loc, CASE WHEN o_orderkey % 7 < 2 THEN 'high' ELSE 'low' END AS conf FROM orders WHERE o_orderstatus <> 'P'),
known AS (SELECT o_orderpriority AS corpus, o_orderkey AS c FROM orders WHERE o_orderkey % 11 = 0)"""


def _candidates(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    label = F.get(F.array(*[F.lit(x) for x in ("dead", "alive", "external", "unsure", None)]), (key % 5).cast("int"))
    selected = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("corpus"), key.alias("candidate"), label.alias("label"), F.when(key % 2 == 0, F.col("o_custkey")).alias("loc"), F.when(key % 7 < 2, "high").otherwise("low").alias("confidence"))
    return selected, o.filter("o_orderkey % 11 = 0").select(F.col("o_orderpriority").alias("corpus"), key.alias("candidate"))


@query(
    f"""{METRICS}, a AS (SELECT corpus, count(*) AS n, coalesce(sum(loc), 0)::BIGINT AS loc, count(loc) AS m, count(*) FILTER (label IN ('dead', 'alive', 'external')) AS r, count(*) FILTER (label IN ('dead', 'alive', 'external') AND conf = 'high') AS h, count(*) FILTER (label = 'dead') AS d FROM sel GROUP BY 1),
b AS (SELECT k.corpus, count(*) AS n, count(s.c) AS f FROM known k LEFT JOIN sel s USING (corpus, c) GROUP BY 1)
SELECT corpus, coalesce(a.n, 0) AS candidate_count, coalesce(loc, 0) AS candidate_loc, coalesce(m, 0) AS loc_measured_count, coalesce(r, 0) AS reviewed_count, coalesce(h, 0) AS reviewed_high_count, coalesce(b.n, 0) AS known_positive_count,
round(d::DECIMAL(18, 4) / nullif(r, 0), 4) AS candidate_precision, round(f::DECIMAL(18, 4) / nullif(b.n, 0), 4) AS known_positive_recall FROM a FULL JOIN b USING (corpus)"""
)
def candidate_metrics(spark, sf_dir):
    return evaluate.candidate_metrics(*_candidates(spark, sf_dir), ["corpus"])


@query("SELECT event_type AS name, sum(event_id % 100)::BIGINT AS seconds, sum(user_id)::BIGINT AS allocated, max(event_id) AS peak_rss_kb FROM events GROUP BY 1")
def phase_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluate.phase_rollup(e.select(F.col("event_type").alias("name"), (F.col("event_id") % 100).alias("seconds"), F.col("user_id").alias("allocated"), F.col("event_id").alias("rss_kb")))


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT -1, NULL, count(*) FROM orders WHERE o_orderkey % 4 >= 2")
def repeated_identities(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "certain")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    least = evaluate.count_at_least(o, rank_of(level), rank_of(F.lit("high")))
    none = F.lit(None).cast(o.schema["o_orderdate"].dataType)
    return evaluate.repeated(o, ["o_custkey", "o_orderdate"]).unionByName(least.select(F.lit(-1).cast("long").alias("o_custkey"), none.alias("o_orderdate"), "n"))


@query("SELECT l_suppkey AS name, min(l_returnflag) AS fact FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1 UNION ALL SELECT -l_orderkey, min(l_returnflag) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def unambiguous_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.col("l_suppkey"), -F.col("l_orderkey"))).alias("name"), F.col("l_returnflag").alias("fact"))
    return evaluate.unambiguous(facts, "name", "fact")


@query(
    """SELECT r_name AS corpus, count(c_custkey) AS changes, count(*) FILTER (c_custkey % 2 = 0) AS required, count(*) FILTER (c_custkey % 6 = 0) AS completed, count(c_custkey) = 0 AS zero_difference, count(c_custkey) AS available, count(*) FILTER (c_acctbal > 5000) AS queued, count(*) FILTER (c_acctbal > 5000 AND c_custkey % 3 = 0) AS queued_high
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_regionkey > 0 LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"""
)
def review_coverage(spark, sf_dir):
    corpora = table(spark, sf_dir, "region").select(F.col("r_name").alias("corpus"), F.col("r_regionkey").alias("_r"))
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(corpora.filter("_r > 0"), F.col("n_regionkey") == F.col("_r"))
    changes = rows.select("corpus", (F.col("c_custkey") % 2 == 0).alias("required"), (F.col("c_custkey") % 3 == 0).alias("reviewed"))
    queued = rows.filter("c_acctbal > 5000").select("corpus", F.when(F.col("c_custkey") % 3 == 0, "high").otherwise("low").alias("confidence"))
    return evaluate.review_coverage(corpora, changes).join(evaluate.queue_summary(corpora, rows, queued), "corpus")


@query("SELECT 'S' || s_suppkey AS definition_id, o.* FROM supplier, (VALUES ('source', 'complete'), ('load', 'partial'), ('dispatch', 'd'), ('framework', 'd'), ('external_contract', 'e'), ('dynamic_evidence', 'positive_only')) AS t(obligation, s), LATERAL (SELECT obligation, CASE s WHEN 'd' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'complete' ELSE 'partial' END WHEN 'e' THEN CASE WHEN s_suppkey % 3 = 0 THEN 'review' ELSE 'complete' END ELSE s END AS status) AS o")
def removal_plan(spark, sf_dir):
    key = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(_text("S", key).alias("definition_id"), (key % 2).alias("n_blockers"), F.when(key % 3 == 0, "public").otherwise("private").alias("visibility"))
    return diagnose.removal_plan(found, "complete", True).drop("required_action")


@query("SELECT p_partkey, 'def:v1:' || sha256(to_json([p_type, p_name, p_brand, p_size::VARCHAR])) AS definition_id FROM part")
def definition_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", evidence.identity("def:v1", ["p_type", "p_name", "p_brand", "p_size"]).alias("definition_id"))
