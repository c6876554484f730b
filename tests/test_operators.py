"""Contracts of single operators on hand-made rows."""

import json
import os

import pytest
from measure import shuffled_rows
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import classify, evidence, fixpoint, lookup, runtime
from factloom.plans import analyzers
from factloom.sources import facts
from factloom.streaming import trace


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_symbol_comes_before_id(spark):
    nodes = spark.createDataFrame([("d1", "A#x"), ("d2", "A#x"), ("A#y", "z"), ("d3", "A#y")], "definition_id string, symbol_id string")
    refs = spark.createDataFrame([("A#x",), ("A#y",), ("d1",), ("none",)], "ref string")
    assert rows(lookup.definition_lookup(refs, nodes)) == [("A#x", "ambiguous", 2, None), ("A#y", "unique", 1, "d3"), ("d1", "exact", 1, "d1"), ("none", "missing", 0, None)]


def test_ordered_lookup_keeps_ties(spark):
    sites = spark.createDataFrame([(1, "C", "m"), (2, "C", "gone")], "site int, owner string, message string")
    chains = spark.createDataFrame([("C", 0, "C"), ("C", 1, "M"), ("C", 2, "B")], "owner string, pos int, candidate string")
    methods = spark.createDataFrame([("M", "m", "d1"), ("M", "m", "d2"), ("B", "m", "d3")], "candidate string, message string, definition_id string")
    assert rows(lookup.ordered_lookup(sites, chains, methods).select("site", "definition_id")) == [(1, "d1"), (1, "d2")]


def test_collided_evidence_goes_entirely(spark):
    e = spark.createDataFrame([("e1", "p1", "a"), ("e1", "p2", "b"), ("e2", "p1", "c"), ("e2", "p1", "c")], "evidence_id string, payload_digest string, edge string")
    assert rows(evidence.accepted(e).select("evidence_id", "edge")) == [("e2", "c")]
    assert rows(evidence.collisions(e)) == [("e1", 2)]


def test_reach_by_domain_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "src string, dst string")
    roots = spark.createDataFrame([("runtime", "a"), ("test", "x")], "domain string, node string")
    got = fixpoint.reach(edges, roots)
    assert rows(got.select("domain", "node", "hops")) == [("runtime", "a", 0), ("runtime", "b", 1), ("runtime", "c", 2), ("test", "a", 2), ("test", "b", 3), ("test", "c", 1), ("test", "x", 0)]
    assert rows(fixpoint.witness_paths(got.filter("domain = 'test'"), spark.createDataFrame([("b",)], "node string"))) == [("b", ["x", "c", "a", "b"])]
    assert fixpoint.reach(edges, roots.limit(0)).count() == 0


def test_closure_of_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert rows(fixpoint.closure(pairs)) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]
    assert fixpoint.closure(pairs.limit(0)).count() == 0


def test_alive_beats_blocked_and_blocked_beats_test(spark):
    flags = "node string, alive boolean, runtime boolean, external boolean, test boolean, n_blockers int, is_uncertain boolean, is_dynamic_owner boolean, is_generated_accessor boolean, is_implicit boolean, is_unobserved boolean, defined_via string"
    no = (False,) * 5
    n = spark.createDataFrame(
        [
            ("a", True, False, False, False, 1, *no, "def"), ("b", False, False, False, True, 1, True, False, False, False, False, "def"), ("c", False, False, False, True, 0, *no, "def"),
            ("d", False, False, False, False, 0, False, True, False, False, True, "def"), ("e", False, False, False, False, 0, False, False, True, True, False, "def"), ("f", False, False, False, False, 0, *no, "rails_scope"),
        ],
        flags,
    )
    got = {r.node: r for r in classify.findings(n).collect()}
    assert {k: (r.classification, r.score, r.confidence, r.actionability, r.state) for k, r in got.items()} == {
        "b": ("blocked", 0.0, "low", "diagnostic", "unknown"),
        "c": ("test_only_reachable", 0.55, "medium", "diagnostic", "statically_reachable"),
        "d": ("unreachable", 0.37, "low", "review_candidate", "unreachable_under_model"),
        "e": ("unreachable", 0.02, "low", "review_candidate", "unreachable_under_model"),
    }
    assert [tuple(c) for c in got["b"].components] == [("base(blocked)", 0.25), ("matching_blocker", 0.0), ("near_metaprogramming", -0.35), ("score_clamp", 0.1)]
    assert [tuple(c) for c in got["d"].components] == [("base(unreachable)", 0.62), ("dynamic_owner", -0.25), ("runtime_unobserved", 0.0)]
    kinds = spark.createDataFrame([("analyzer_failure",), ("reference_scan_incomplete",), ("unknown_dispatch",)], "k string")
    assert [r[0] for r in kinds.select(classify.severity(F.col("k"))).collect()] == ["invalid", "degraded", None]


def test_runtime_joins(spark):
    hits = spark.createDataFrame([("f", 64), ("f", 200), ("g", 5)], "file string, line int")
    spans = spark.createDataFrame([("f", 10, 64, "a"), ("f", 60, 130, "b"), ("g", 6, 9, "c")], "file string, first int, last int, span string")
    assert rows(runtime.line_interval_join(hits, spans).select("line", "span")) == [(64, "a"), (64, "b")]
    paths = spark.createDataFrame([("/srv/app/lib/x.rb",), ("lib/x.rb",), ("/q/lib/y.rb",), ("/r/lib/y.rb",), ("./z.rb",), ("oz.rb",)], "path string")
    known = spark.createDataFrame([("lib/x.rb",), ("app/lib/x.rb",), ("lib/y.rb",), ("z.rb",), ("none.rb",), (None,)], "file string")
    assert rows(runtime.coverage_paths(known, paths)) == [("app/lib/x.rb", "/srv/app/lib/x.rb"), ("lib/x.rb", "lib/x.rb"), ("lib/y.rb", "/q/lib/y.rb"), ("lib/y.rb", "/r/lib/y.rb"), ("z.rb", "./z.rb")]


def test_globs_and_ratios(spark):
    df = spark.createDataFrame([("app/models/a.rb",), ("lib/a.rb",), ("a.py",)], "p string")
    take = lambda g: [r[0] for r in df.filter(scalars.matches_any(F.col("p"), g)).collect()]
    assert take(["app/**/*.rb"]) == ["app/models/a.rb"] and take(["**/*.{rb,py}"]) == ["app/models/a.rb", "lib/a.rb", "a.py"] and take([]) == []
    df = spark.createDataFrame([("a{b",), ("b.rb",), ("d.rb",), ("x/y",)], "p string")
    assert take(["a{b"]) == ["a{b"] and take(["[bc].rb"]) == ["b.rb"] and take(["[!b-c].rb"]) == ["d.rb"] and take(["x[!a]y"]) == [] and take(["[b"]) == [] and take(["{b,{d,e}}.rb"]) == ["b.rb", "d.rb"]
    one = spark.range(1).select(scalars.ratio(F.lit(1), F.lit(0)), scalars.nullable_ratio(F.lit(1), F.lit(0)), scalars.nearest_rank(F.array(*map(F.lit, [1, 2, 3, 4])), 95)).first()
    assert tuple(one) == (0.0, None, 4)


def test_ndjson_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("d1", "A#x", "instance_method", "a.rb", 1, 2, "A", "x", False, "public")], facts.SCHEMAS["node"])
    edges = spark.createDataFrame([("d1", "d2", None)], facts.SCHEMAS["edge"])
    facts.write_ndjson({"node": nodes, "edge": edges}, str(tmp_path / "out"), {"title": "t"}, {"projection": "all"})
    back = facts.read_ndjson(spark, str(tmp_path / "out"))
    assert rows(back["node"]) == rows(nodes) and rows(back["edge"]) == rows(edges) and back["entry_point"].count() == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["record"] for x in lines) == ["edge", "graph_metadata", "node", "report"] and all(isinstance(x["data"], dict) for x in lines)
    with pytest.raises(Exception, match="version"):
        facts.read_ndjson(spark, str(tmp_path / "out"), "other")["edge"].collect()
    files = spark.createDataFrame([("a", "1"), ("b", None)], "path string, content string")
    assert rows(facts.snapshot_digest(files)) == rows(facts.snapshot_digest(files.orderBy(F.desc("path"))))
    assert facts.snapshot_digest(files).first().digest != facts.snapshot_digest(files.fillna("")).first().digest and facts.snapshot_digest(files.limit(0)).first().n_files == 0


def test_stream_of_calls(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [("t1", 1, "call", "a"), ("t1", 2, "call", "b"), ("t1", 3, "call", "lost"), ("t1", 5, "return", "never"), ("t1", 4, "return", "b"), ("t2", 1, "call", "z"), ("t1", 6, "call", "c")]
    for k, batch in enumerate([events[:2], events[2:]]):
        path = source / f"{k}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("thread", "seq", "event", "name"), e))) for e in batch))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    stream = spark.readStream.schema("thread string, seq long, event string, name string").option("maxFilesPerTrigger", 1).json(str(source))
    q = trace.stack_edges(stream).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    assert rows(spark.table("calls")) == [("t1", "a", "b"), ("t1", "a", "c"), ("t1", "b", "lost")]


def test_evidence_identity_and_scopes(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "q"), ("", "q")], "x string, y string")
    assert evidence.with_payload(df, ["x", "y"], ["y"]).select("evidence_id").distinct().count() == 4
    scopes = spark.createDataFrame([({"source_revision": "1", "env": "p"}, {"source_revision": "1"}, None), ({"source_revision": "2"}, {"source_revision": "1"}, None), ({"source_revision": "1"}, {"source_revision": "1"}, "stale"), ({"env": "p"}, {"env": "p"}, None), ({"env": "p"}, None, None)], "a map<string,string>, r map<string,string>, s string")
    assert [r[0] for r in scopes.select(evidence.observed_verified(F.col("a"), F.col("r"), F.col("s"))).collect()] == [True, False, False, False, False]
    e = spark.createDataFrame([("e1", "p1", "r"), ("e1", "p2", "t"), ("e2", "p1", "r")], "evidence_id string, payload_digest string, d string")
    assert rows(evidence.collision_report(e, "d")) == [("e1", 2, ["p1", "p2"], ["r", "t"])]


def test_small_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    text = F.lit
    assert value(scalars.lower_camel(text("a_b?"))) == "aB?" and value(scalars.method_name(text("A::B#c.d"))) == "c.d" and value(scalars.method_name(text("x"))) == "x"
    assert value(scalars.reference_tokens(text("no-name"))) == [] and value(scalars.annotation_escape(text("a%\nb"))) == "a%25%0Ab"
    assert value(scalars.camelize(text("api/user_html"), {"api": "API", "html": "HTML"})) == "API::UserHTML"
    assert value(scalars.string_list(F.array(text("b"), text(""), text(None), text("a"), text("b")))) == ["a", "b"]
    assert [value(scalars.revision_status(text(g), text(c), text(s))) for g, c, s in [("a", "a", True), (None, "a", False), ("a", "", False), ("a", "a", None), ("a", "b", False)]] == ["stale", "unknown", "provided_unverified", "match", "mismatch"]
    assert value(scalars.loc(text(3), text(None).cast("int"))) == 1 and value(scalars.loc(text(3), text(9))) == 7 and value(scalars.loc(text(None).cast("int"), text(9))) == 0
    assert value(scalars.relative_limit(text(2.0), text(1.5), text(0.5), text(2.8))) == 2.8 and value(scalars.observation_days(F.to_timestamp(text("2020-01-01 00:00:00")), F.to_timestamp(text("2020-01-02 00:00:01")))) == 2
    assert value(scalars.bounded_snippet(text("  a   b  "))) == "a b" and value(scalars.bounded_snippet(text("é" * 9), 5)) == "éé…"
    words = {"person": "people"}, ["news"], [("(?:s|x)$", "$0es"), ("y$", "ies")]
    assert [value(scalars.pluralize(text(w), *words)) for w in ("person", "news", "box", "city", "cat")] == ["people", "news", "boxes", "cities", "cats"]
    assert value(scalars.constant_candidates(text("X"), F.array(text("A::B"), text("A")))) == ["A::B::X", "A::X", "X"]


def test_reports_and_gates(spark):
    from factloom.operators import evaluate, guard, report, roots

    f = spark.createDataFrame([("a", "unreachable", "review_candidate", "medium", 0, True), ("b", "blocked", "diagnostic", "low", 2, True), ("c", "unreachable", "review_candidate", "low", 1, True), ("d", "unused", "review_candidate", "high", 0, False)], "id string, classification string, actionability string, confidence string, n_blockers int, complete boolean")
    assert sorted(r.id for r in report.broken(f).collect()) == ["c", "d"]
    assert {k: sorted(r.id for r in v.collect()) for k, v in report.split(f, "medium").items()} == {"actionable": ["a", "d"], "blocked": ["b"], "diagnostic": ["c"]}
    assert json.loads(report.sarif_results(f.withColumn("file", F.lit("x.rb")).withColumn("line", F.lit(3))).first().value)["locations"][0]["physicalLocation"]["region"] == {"startLine": 3}
    checks = spark.createDataFrame([("x", True), ("y", None)], "check string, passed boolean")
    assert tuple(evaluate.gate(checks).first()) == (False, 2, ["y"]) and evaluate.gate(checks.filter("check = 'x'")).first().passed and not evaluate.gate(checks.limit(0)).first().passed
    pair = lambda r, c: spark.createDataFrame([(r, c)], "root string, configuration_sha256 string")
    assert guard.comparability(pair("a", "1"), pair("b", None)).first().reasons == ["root_mismatch", "configuration_missing"] and guard.comparability(pair("a", "1"), pair("a", "1")).first().comparable
    now = spark.createDataFrame([("p1", "f", "low", True), ("p2", "g", "low", True), ("p3", "g", "low", False)], "physical_fingerprint string, file string, confidence string, is_candidate boolean")
    got = guard.ci_check(now, now.limit(1), "degraded", ["c1"], ["c1", "c2"], spark.createDataFrame([("f",)], "file string"))
    assert rows(got) == [("analysis_health", False, 1), ("new_candidates", True, 0), ("ratchet", False, 1)]
    nodes = spark.createDataFrame([("d1", "block_entry", "bin/x.rb", False, "b"), ("d2", "block_entry", "spec/x.rb", True, "t"), ("d3", "instance_method", "lib/x.rb", False, "A::B#go")], "definition_id string, kind string, file string, test boolean, symbol_id string")
    assert rows(roots.merged(roots.script_roots(nodes, ["bin/*.rb"]), roots.test_roots(nodes), roots.declared_roots(nodes, ["A*go"]))) == [("d1", "runtime", "main_script"), ("d2", "test", "test_suite"), ("d3", "runtime", "public_api_declared")]
    assert tuple(roots.unrooted_units(nodes, nodes.limit(0).select("definition_id"), nodes.select(F.col("definition_id").alias("caller_id"))).first()) == (1, ["bin/x.rb"])
    edges = spark.createDataFrame([("d1", "gone", 1)], "caller_id string, callee_id string, call_site_id int")
    issues = report.self_check(nodes, edges, spark.createDataFrame([(1, "complete", 1), (1, "partial", 0), (2, "complete", 1)], "call_site_id int, status string, n_targets int"), f)
    assert dict(map(tuple, issues.collect())) == {"unknown_edge_end": 1, "repeated_site": 1, "complete_without_edge": 1, "broken_finding": 2}
    known = spark.createDataFrame([("k", "d1", "i1"), ("k", None, "i2"), ("k", "d9", "i2")], "corpus string, definition_id string, id string")
    selected = spark.createDataFrame([("k", "d1", "i9"), ("k", None, "i2")], "corpus string, definition_id string, id string")
    assert sorted((r.id, r.recalled) for r in evaluate.recalled(known, selected).collect()) == [("i1", True), ("i2", False), ("i2", True)]
    _, faults = evaluate.attach_labels(selected, spark.createDataFrame([("i2", "dead"), ("i2", "dead"), ("i5", "alive")], "id string, value string"), ["id"])
    assert rows(faults) == [("i2", "repeated"), ("i5", "unmatched")]


def test_arity_and_private(spark):
    from factloom.operators import dispatch

    rows = [
        (1, 1, [], 1, 2, [], [], False, False),
        (2, 0, [], 1, 2, [], [], False, True),
        (3, 3, [], 1, 2, [], [], False, True),
        (4, 9, [], 1, None, [], [], False, False),
        (5, 1, ["a"], 1, 1, [], [], False, True),  # keywords become a positional
        (6, 1, ["a"], 2, 2, None, None, None, False),
        (7, 1, ["a"], 1, 1, ["a"], ["a"], False, False),
        (8, 1, [], 1, 1, ["a"], ["a"], False, True),
        (9, 1, ["b"], 1, 1, [], ["a"], False, True),
        (10, 1, ["b"], 1, 1, [], [], True, False),
    ]
    df = spark.createDataFrame(rows, "i int, g int, kw array<string>, lo int, hi int, req array<string>, acc array<string>, rest boolean, want boolean")
    got = df.withColumn("got", dispatch.arity_rejected(*[F.col(c) for c in ("g", "kw", "lo", "hi", "req", "acc", "rest")]))
    assert [r.i for r in got.collect() if r.got != r.want] == []
    calls = [(1, "private", "constant", None, None, True), (2, "private", "self", None, None, False), (3, "private", None, "send", None, False), (4, "private", "constant", "respond_to?", False, True),
             (5, "private", "constant", "respond_to?", True, False), (6, "private", "constant", "respond_to?", None, False), (7, None, None, None, None, False), (8, "public", "constant", None, None, False)]
    df = spark.createDataFrame(calls, "i int, v string, r string, o string, p boolean, want boolean")
    got = df.withColumn("got", dispatch.private_rejected(*[F.col(c) for c in ("v", "r", "o", "p")]))
    assert [r.i for r in got.collect() if r.got != r.want] == []


def test_super_starts_after_the_current_owner(spark):
    from factloom.operators import dispatch

    sites = spark.createDataFrame([(1, "A", "A", "m"), (2, "A", "B", "m"), (3, "A", "X", "m"), (4, None, None, "m")], "site int, owner string, current string, message string")
    chains = spark.createDataFrame([("A", 0, "A"), ("A", 1, "B"), ("A", 2, "C")], "owner string, pos int, candidate string")
    methods = spark.createDataFrame([("A", "m", "a"), ("B", "m", "b1"), ("B", "m", "b2"), ("C", "m", "c")], "candidate string, message string, definition_id string")
    got = sorted((r.site, r.definition_id) for r in dispatch.super_lookup(sites, chains, methods).collect())
    assert got == [(1, "b1"), (1, "b2"), (2, "c")]


def test_equal_sites_are_looked_up_once(spark):
    """500 equal sites of 200 definitions are 100,000 pairs, which the last join gives out; none is shuffled or sorted."""
    from factloom.operators import dispatch

    sites = spark.range(500).selectExpr("id as site", "'A' as owner", "if(id = 7, null, 'm') as message", "'A' as current", "if(id % 2 = 0, null, 1) as note")
    chains = spark.createDataFrame([("A", 0, "A"), ("A", 1, "B")], "owner string, pos int, candidate string")
    methods = spark.range(400).selectExpr("if(id % 2 = 0, 'A', 'B') as candidate", "'m' as message", "id as definition_id")
    got, above = [], []
    assert shuffled_rows(spark, lambda: got.extend(lookup.ordered_lookup(sites, chains, methods).select("site", "definition_id").collect())) < 10_000
    assert shuffled_rows(spark, lambda: above.extend(dispatch.super_lookup(sites, chains, methods).select("site", "definition_id").collect())) < 10_000
    asked = [s for s in range(500) if s != 7]
    assert sorted(map(tuple, got)) == [(s, d) for s in asked for d in range(0, 400, 2)]
    assert sorted(map(tuple, above)) == [(s, d) for s in asked for d in range(1, 400, 2)]
