"""Diagnostics on a small graph whose answers are known."""

from measure import shuffled_rows
from pyspark.sql import functions as F

from factloom.operators import diagnose, fixpoint


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_why_paths_and_steps(spark):
    edges = spark.createDataFrame([("r", "a", "e1"), ("a", "b", "e2"), ("a", "b", "e3"), ("t", "c", "e4"), ("t", "d", "e5")], "caller_id string, callee_id string, evidence_id string")
    roots = spark.createDataFrame([("runtime", "r", "script"), ("test", "t", "spec")], "domain string, definition_id string, reason string")
    reached = fixpoint.reach(edges.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), roots.select("domain", F.col("definition_id").alias("node")))
    nodes = spark.createDataFrame([(x,) for x in "rabtcdz"], "definition_id string")
    told = diagnose.why(nodes, reached, spark.createDataFrame([("b",), ("d",)], "definition_id string"))
    got = {r.definition_id: (r.status, r.kind, r.path) for r in told.collect()}
    assert got["b"] == ("alive", "runtime", ["r", "a", "b"]) and got["c"] == ("alive", "test", ["t", "c"])
    assert got["d"] == ("blocked", None, None) and got["z"] == ("dead", None, None)
    steps = rows(diagnose.path_steps(told.filter("definition_id = 'b'"), edges, roots))
    assert steps == [("b", 0, "r", "script", None, None), ("b", 1, "a", None, "r", ["e1"]), ("b", 2, "b", None, "a", ["e2", "e3"])]


def test_nearest_alive_is_the_search_of_one_node(spark):
    pairs = [("n1", "n2"), ("n3", "n2"), ("n3", "z"), ("n4", "n1"), ("a", "n4"), ("n5", "n6"), ("n1", "n1")]
    alive = {"a": "runtime", "z": "test"}
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    def search(start):
        seen, queue = {start: 0}, [start]
        for at in queue:
            for n in sorted(near[at] - set(seen)):
                seen[n] = seen[at] + 1
                if n in alive:
                    return (start, n, alive[n], seen[n])
                queue.append(n)
        return None

    got = diagnose.nearest_alive(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(list(alive.items()), "node string, kind string"), spark.createDataFrame([(x,) for x in near], "node string"))
    assert rows(got) == sorted(x for x in map(search, set(near) - set(alive)) if x)


def test_questions_and_explanations(spark):
    nodes = spark.createDataFrame([("d1", "A#pay"), ("d2", "A#pay"), ("d3", "Bill.Payer")], "definition_id string, symbol_id string")
    got = {r.id: tuple(r)[1:] for r in diagnose.asked(spark.createDataFrame([(x,) for x in ("A#pay", "d1", "Bill.Payer", "X#PAY", "q")], "id string"), nodes).collect()}
    assert got == {"A#pay": ("ambiguous", None, None), "d1": ("node", "d1", None), "Bill.Payer": ("node", "d3", None), "X#PAY": ("not_found", None, ["A#pay", "Bill.Payer"]), "q": ("not_found", None, None)}
    findings = spark.createDataFrame([("d1", "unreachable", 0.5)], "definition_id string, classification string, score double")
    assert {r.definition_id: r.status for r in diagnose.explain(nodes, findings).collect()} == {"d1": "finding", "d2": "alive", "d3": "alive"}


def test_why_not(spark):
    cols = "definition_id string, name string, classification string, runtime boolean, external boolean, test boolean, visibility string, defined_via string, n_same int, owner string, dynamic_owner boolean, test_definition boolean"
    plain = (False, False, False)
    nodes = spark.createDataFrame([
        ("d1", "x", "unreachable", *plain, "private", "def", 1, "A", False, False), ("d2", "y", "unreachable", *plain, "public", "attr", 2, None, True, True),
        ("d3", "z", None, True, False, False, "private", "def", 1, "A", False, False), ("d4", "w", "blocked", *plain, "private", "def", 1, "A", False, False), ("d5", "v", None, False, False, True, "private", "def", 1, "A", False, False),
        ("d6", "u", None, *plain, "private", "def", 1, "A", False, False),
    ], cols)
    sites = spark.createDataFrame([(1, "x"), (2, "q"), (3, "x")], "call_site_id int, message string")
    resolutions = spark.createDataFrame([(1, "n", "complete"), (2, "n", "partial")], "call_site_id int, producer string, status string")
    got = {r.definition_id: r for r in diagnose.why_not(
        nodes, sites, resolutions, spark.createDataFrame([(2, "d1")], "call_site_id int, definition_id string"),
        spark.createDataFrame([(1, "d1", "private_visibility"), (3, "d1", "arity")], "call_site_id int, definition_id string, reason string"), spark.createDataFrame([("d4", "eval", "dynamic")], "definition_id string, kind string, reason string"), limit=1,
    ).collect()}
    assert {k: (r.state, r.action) for k, r in got.items()} == {"d1": ("candidate", "verify"), "d2": ("candidate", "review"), "d3": ("runtime_reachable", "keep"), "d4": ("blocked", "review"), "d5": ("test_only", "observe"), "d6": ("not_classified", "verify")}
    assert got["d2"].risk_flags == ["duplicate_or_redefinition", "dynamic_owner", "generated_method", "no_owner", "public_or_protected_visibility", "test_definition"]
    one = got["d1"]
    assert one.n_sites == 3 and tuple(one.resolution_status) == (1, 1, 0, 1)
    assert tuple(one.rejections)[1:] == (2, 1, True) and one.rejections["items"][0].reason == "arity"
    assert got["d4"].risk_flags == ["analysis_incomplete"] and got["d6"].blockers.total == 0


def test_graph_checks(spark):
    kinds = "call_site_id int, producer string, status string, unknown_scope string, target_definition_ids array<string>"
    res = spark.createDataFrame([(1, "p", "complete", None, ["d1", "d9"]), (2, "p", "complete", "all", ["d9"]), (3, "p", "partial", None, ["d1"]), (9, "p", "partial", None, [])], kinds)
    sites = spark.createDataFrame([(1, "c1", None), (2, "c1", None), (3, "c2", None), (3, "c3", None), (4, "c4", 1), (5, "c4", None)], "call_site_id int, caller_id string, derived_from int")
    nodes = spark.createDataFrame([("d1",)], "definition_id string")
    edges = spark.createDataFrame([("c9", "d1", None), ("c1", "d2", "e"), ("c1", "d2", None)], "caller_id string, callee_id string, evidence_id string")
    got = rows(diagnose.resolution_issues(res, sites, nodes, edges))
    assert got == sorted([(1, "p", "unknown_target_definition", "d9"), (1, "p", "missing_target_edge", "d1"), (2, "p", "unknown_target_definition", "d9"), (3, "p", "ambiguous_call_site", None), (9, "p", "unknown_call_site", None)], key=repr)
    candidates = spark.createDataFrame([("k1", 0), ("k2", 1), ("k3", 0)], "definition_id string, n_blockers int")
    check = rows(diagnose.self_check(res, sites, nodes, edges, candidates, spark.createDataFrame([("k3",)], "definition_id string")))
    assert check == sorted([
        ("complete_resolution_has_unknown_scope", "2"), ("resolution_call_site_missing", "9"), ("resolution_target_missing", "1"), ("derived_call_site_has_no_resolution", "4"),
        ("edge_has_no_evidence", "c9->d1"), ("actionable_finding_has_matching_blocker", "k2"), ("actionable_finding_has_matching_blocker", "k3"),
    ])
    health = spark.createDataFrame([("invalid",)], "status string")
    assert rows(diagnose.doctor(True, False, health, nodes.limit(0), nodes)) == [("analysis_health", "issue", "error", 0), ("ci_threshold", "ok", "ok", 0), ("load_roots", "issue", "warning", 1), ("scope", "ok", "ok", 0)]
    plan = {r.obligation: r.status for r in diagnose.removal_plan(spark.createDataFrame([("d1", 0, "public")], "definition_id string, n_blockers int, visibility string"), "complete", True).collect()}
    assert plan == {"source": "complete", "load": "partial", "dispatch": "complete", "framework": "complete", "external_contract": "review", "dynamic_evidence": "positive_only"}
    assert rows(diagnose.feedback_verdict(nodes, True)) == [(False, 1)] and rows(diagnose.feedback_verdict(nodes, False)) == [(True, 1)]


def test_incoming_sites_are_counted_by_name(spark):
    """300 nodes and 300 sites of one name are 90,000 pairs; their counts come from one row of the name, beside all pairs in Python."""
    nodes = spark.range(300).selectExpr("concat('d', id) as definition_id", "'x' as name").unionByName(spark.createDataFrame([("d1", "y"), ("e", "z")], "definition_id string, name string"))
    sites = spark.range(300).selectExpr("id as call_site_id", "if(id < 290, 'x', 'y') as message").unionByName(spark.createDataFrame([(5, "y"), (900, None)], "call_site_id long, message string"))
    resolutions = spark.createDataFrame([(1, "p", "complete"), (1, "q", "partial"), (295, "p", "unknown"), (2, "p", None)], "call_site_id long, producer string, status string")
    targets = spark.createDataFrame([(1, "d2"), (295, "d2"), (295, "d1"), (900, "e"), (7, "none")], "call_site_id long, definition_id string")
    got = []
    assert shuffled_rows(spark, lambda: got.extend(tuple(r) for r in diagnose.incoming_counts(nodes, sites, resolutions, targets).collect())) < 20_000
    states = {}
    for r in resolutions.collect():
        states.setdefault(r.call_site_id, []).append(r.status or "unrecorded")
    seen = {(n.definition_id, s.call_site_id) for n in nodes.collect() for s in sites.collect() if s.message == n.name}
    seen |= {(r.definition_id, r.call_site_id) for r in targets.collect() if r.definition_id != "none"}
    want = {}
    for d, site in seen:
        one = want.setdefault(d, [0] * 5)
        one[0] += 1
        for s in states.get(site, ["unrecorded"]):
            one[1 + diagnose.STATUSES.index(s)] += 1
    assert sorted(got) == sorted((d, *n) for d, n in want.items())
