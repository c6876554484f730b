"""Analyses end to end: analyzers on hand-made facts, the ledger's rules, derived sites, pruning, and reachability after changes."""

import random

import pytest
from pyspark.sql import functions as F
from test_dispatch import CLASS, NODE, SITE, klass

from factloom.operators import chains, derived, fixpoint, incremental
from factloom.operators.ledger import Ledger, Result
from factloom.plans import analyzers

ROOT = "domain string, node string"
EVIDENCE = "site string, caller_id string, callee_id string, grade string"


def made(spark, rows=(), **over):
    """Facts of five classes; ``rows`` are more sites."""
    classes = [klass("Base"), klass("Leaf", "Base"), klass("Unmade", "Base"), klass("Dyn", "Base", dynamic=True)]
    nodes = [(f"{o}_{m}", "instance_method", o, m, "public", False) for o, m in [("Leaf", "go"), ("Unmade", "go"), ("Dyn", "go"), ("Base", "run"), ("Leaf", "main")]]
    nodes += [(f"m{i}", "instance_method", f"X{i}", "many", "public", False) for i in range(5)] + [("T_go", "instance_method", "Leaf", "go", "public", True)]
    rest = (False, False, None, None, None)
    sites = [(1, "Leaf_main", "go", "instance", "Base", *rest), (2, "Leaf_main", "run", "instance", "Leaf", *rest), (3, "Leaf_main", "go", "unknown", None, *rest), (4, "Leaf_main", "many", "unknown", None, *rest), (5, "Leaf_main", "none", "instance", "Leaf", *rest), *rows]
    given = {
        "nodes": spark.createDataFrame(nodes, NODE),
        "sites": spark.createDataFrame(sites, SITE),
        "classes": spark.createDataFrame(classes, CLASS),
        "roots": spark.createDataFrame([("runtime", "Leaf_main")], ROOT),
        "instantiated": spark.createDataFrame([("Leaf",)], "owner string"),
    }
    return analyzers.Facts(**(given | over))


def edges_by(ledger, producer):
    return {(r.call_site_id, r.callee_id, r.grade) for r in ledger.table("evidence").filter(F.col("producer") == producer).collect()}


@pytest.fixture(scope="module")
def legacy(spark):
    return analyzers.run(made(spark), analyzers.static_analyzers("legacy"))


def test_static_analyzers(legacy):
    analysis = legacy
    ledger = analysis.ledger
    assert ledger.producers == ["name_resolution", "cha", "rta"] and not ledger.failed
    named = {("3", f"{o}_go", "heuristic") for o in ("Leaf", "Unmade", "Dyn")}
    assert edges_by(ledger, "name_resolution") == {("2", "Base_run", "exact")} | named
    wide = {("1", f"{o}_go", "conservative") for o in ("Leaf", "Unmade", "Dyn")} | {("1", "T_go", "conservative")}
    assert edges_by(ledger, "cha") == wide | {("2", "Base_run", "conservative")} | {(s, c, "conservative") for s, c, _ in named}
    kept = {(s, c) for s, c, _ in edges_by(ledger, "rta")}
    assert kept == {("1", "Leaf_go"), ("1", "T_go"), ("1", "Dyn_go"), ("2", "Base_run"), ("3", "Leaf_go"), ("3", "Dyn_go")}
    states = {(r.producer, r.call_site_id): r.status for r in ledger.table("resolutions").collect()}
    assert [states["name_resolution", str(i)] for i in range(1, 6)] == ["unknown", "complete", "partial", "unknown", "unknown"]
    assert [states["cha", str(i)] for i in range(1, 6)] == ["partial", "complete", "partial", "unknown", "unknown"]
    blocked = ledger.table("blockers").collect()
    assert [(r.scope_kind, r.scope_value, r.reason, r.n_sites) for r in blocked] == [("message", "many", "ambiguity_limit_exceeded", 1)]
    reached = {r.node for r in analysis.reached.collect()}
    assert reached == {"Leaf_main", "Leaf_go", "T_go", "Dyn_go", "Base_run"}
    found = {r.node: r.classification for r in analysis.findings().collect()}
    assert found == {"Unmade_go": "unreachable"} | {f"m{i}": "blocked" for i in range(5)}


def test_evidence_ids_are_of_producer_and_call(spark, legacy):
    ledger = legacy.ledger
    rows = ledger.table("evidence").collect()
    assert len({r.evidence_id for r in rows}) == len(rows)
    again = analyzers.collect(made(spark), [analyzers.NameResolution()]).table("evidence")
    assert {r.evidence_id for r in again.collect()} == {r.evidence_id for r in rows if r.producer == "name_resolution"}
    stated = {(r.producer, r.call_site_id): set(r.evidence_ids) for r in ledger.table("resolutions").collect()}
    for r in rows:
        assert r.evidence_id in stated[r.producer, r.call_site_id]


def test_modes(legacy):
    """Pruning derived from the unpruned reachability gives the same as a whole run with it."""
    base = analyzers.Analysis(legacy.facts, analyzers.collect(legacy.facts, [analyzers.NameResolution(), analyzers.CHA()]))
    assert {r.node for r in base.reached.collect()} >= {"Unmade_go"}
    plain = analyzers.RTA().analyze(base.facts, base.ledger)
    assert plain.evidence.isEmpty() and plain.retracted is None  # all its edges are there already
    after, changed = analyzers.pruned(base)
    assert {(r.domain, r.node) for r in after.collect()} == {(r.domain, r.node) for r in legacy.reached.collect()}
    assert {(r.node, r.change) for r in changed.collect()} == {("Unmade_go", "lost")}
    with pytest.raises(ValueError):
        analyzers.RTA("none")


def test_grouped_sites_tell_the_same(spark):
    """300 equal sites are one request: the same evidence and the same numbers of blocked sites."""
    rest = (False, False, None, None, None)
    rows = [(100 + i, "Leaf_main" if i % 2 else "nobody", m, kind, who, *rest) for i in range(300) for m, kind, who in [[("go", "instance", "Base"), ("many", "unknown", None), ("sort", "instance", "Array")][i % 3]]]
    plain = made(spark, rows)
    facts = plain.grouped()
    assert facts.sites.filter("site like 'request:%'").count() < 15
    assert facts.sites.filter("message = 'sort'").count() == 100  # a derived site's id is made of its parent's
    told = lambda facts, rows: sorted(map(str, (tuple(r) for r in rows.select("producer", "call_site_id", "caller_id", "callee_id", "grade").collect())))
    one, other = (analyzers.collect(f, [analyzers.NameResolution()]) for f in (plain, facts))
    assert not other.failed and told(plain, one.evidence()) == told(facts, analyzers.expanded(facts, other.evidence()))
    barred = lambda ledger: sorted((r.blocker_id, r.message, r.n_sites) for r in ledger.blockers().collect())
    assert barred(one) == barred(other)


def test_unknown_receivers_reach_kept_definitions_only(spark):
    """Names beyond the limit are open to unknown receivers only, and then by the same rules as any candidate."""
    rest = (False, False, None, None, None)
    facts = made(spark, [(6, "Leaf_main", "many", "self", None, *rest)], instantiated=spark.createDataFrame([("X1",), ("X3",)], "owner string"))
    ledger = analyzers.collect(facts, [analyzers.RTA("legacy")])
    assert {c for s, c, _ in edges_by(ledger, "rta") if s == "4"} == {"m1", "m3"}
    assert {c for s, c, _ in edges_by(ledger, "rta") if s == "6"} == set()


def test_failing_analyzers_add_nothing(spark):
    class One:
        name, version, may_complete = "one", "1", False

        def analyze(self, facts, ledger):
            return Result(spark.createDataFrame([("s", "r", "a", "exact"), ("s", "a", "b", "exact")], EVIDENCE))

    class Late(One):
        name = "late"

        def analyze(self, facts, ledger):
            return Result(spark.range(1).selectExpr("'s' as site", "raise_error('late') as caller_id", "'a' as callee_id", "'exact' as grade"))

    class Bold(One):
        name = "bold"

        def analyze(self, facts, ledger):
            return Result(resolutions=spark.createDataFrame([("s", "complete", "x")], "site string, status string, reason string"))

    class Twice(One):
        name = "twice"

        def analyze(self, facts, ledger):
            return Result(One.analyze(self, facts, ledger).evidence, spark.createDataFrame([("s", "partial", "x"), ("s", "unknown", "x")], "site string, status string, reason string"))

    class Broken(One):
        name = "broken"

        def analyze(self, facts, ledger):
            raise KeyError("no such fact")

    nodes = spark.createDataFrame([(x, "instance_method", "O", x, "public", False) for x in "rabc"], NODE)
    facts = made(spark, nodes=nodes, roots=spark.createDataFrame([("runtime", "r")], ROOT))
    found = lambda a: {r.node: r.classification for r in a.findings().collect()}
    assert found(analyzers.run(facts, [One()])) == {"c": "unreachable"}
    for failing in (Late(), Bold(), Twice(), Broken()):
        analysis = analyzers.run(facts, [One(), failing])
        assert analysis.ledger.producers == ["one"] and list(analysis.ledger.failed) == [failing.name]
        assert found(analysis) == {"c": "blocked"}
        assert analysis.ledger.table("evidence").count() == 2
    double = analyzers.run(facts, [One(), One()])
    assert double.ledger.table("evidence").count() == 2 and found(double) == {"c": "blocked"}


def test_runtime_import_completes_nothing(spark):
    calls = spark.createDataFrame([("Leaf_main", "Unmade_go")], "caller_id string, callee_id string")
    ledger = analyzers.collect(made(spark), [analyzers.RuntimeImport(calls)])
    assert edges_by(ledger, "runtime") == {(None, "Unmade_go", "observed")}
    assert ("Leaf_main", "Unmade_go") in {(r.caller_id, r.callee_id) for r in ledger.edges().collect()}


def test_eligibility(spark):
    nodes = [("test", "instance_method", "T", "test", "public", True, "analyze", None), ("ref", "instance_method", "T", "ref", "public", False, "reference", None), ("gen", "instance_method", "T", "gen", "public", False, "analyze", "rails_attribute"), ("root", "file", None, "root", None, False, "analyze", None), ("plain", "instance_method", "T", "plain", "public", False, "analyze", "def")]
    facts = made(spark, nodes=spark.createDataFrame(nodes, NODE + ", domain string, defined_via string"), roots=spark.createDataFrame([], ROOT))
    assert [r.node for r in analyzers.run(facts, []).findings().collect()] == ["plain"]


def test_ledger_supports(spark):
    ledger = Ledger(spark)
    rows = spark.createDataFrame([("1", "a", "b", "exact"), ("2", "a", "b", "exact")], EVIDENCE)
    assert ledger.edges().count() == 0 and ledger.apply("p", "1", Result(rows))
    ids = [r.evidence_id for r in ledger.evidence().orderBy("call_site_id").collect()]
    assert [tuple(r) for r in ledger.edges().collect()] == [("a", "b", 2)]
    ledger.apply("q", "1", Result(retracted=spark.createDataFrame([(ids[0],)], "evidence_id string")))
    assert [tuple(r) for r in ledger.edges().collect()] == [("a", "b", 1)]
    ledger.apply("r", "1", Result(retracted=spark.createDataFrame([(ids[1],)], "evidence_id string")))
    assert ledger.edges().count() == 0


FACT_SITE = SITE.replace("site int", "site string") + f", receivers array<string>, receiver_fact {derived.FACT}, argument_facts array<{derived.FACT}>, block_kind string, positional_count int"


def test_derived_sites(spark):
    types = lambda *v, exact=True: ("instance_types", exact, list(v), None, None)
    array = ("container", True, None, "array", ("instance_types", True, ["B", "A", ""]))

    def site(name, message, kind="instance", receiver=None, **f):
        return (name, "caller", message, kind, receiver, False, False, None, None, None, f.get("receivers"), f.get("fact"), f.get("args"), f.get("block"), f.get("n"))

    sites = spark.createDataFrame(
        [
            site("map", "map", receiver="Array", block="given"), site("bare", "map", receiver="Array", block="none"), site("sum", "inject", receiver="Hash"), site("own", "map", receiver="Own"),
            site("sort", "sort", fact=array), site("by", "sort_by", receiver="Array", block="given"), site("not", "sort_by", receiver="Array", block="nil"), site("most", "max", receivers=["Set", "Array"], block="given"),
            site("put", "puts", "self", args=[types("B", "A"), types("C", exact=False)], n=3), site("void", "puts", "implicit", n=0), site("open", "print", "implicit"), site("found", "puts", "implicit"),
            site("ask", "respond_to?", receiver="Own"), site("known", "method", receiver="Own"), site("other", "each", receiver="Array"),
        ],
        FACT_SITE,
    )
    one = lambda name: spark.createDataFrame([(name,)], "site string")
    out = derived.implied(sites, one("found"), one("known"))
    got = sorted(((r.parent_site, r.message, r.receiver_kind, r.receiver_name, r.flow_types) for r in out.collect()), key=repr)
    none = ("unknown", None, [])
    same, item = ("instance", "Array", None), ("instance", "A", ["A", "B"])
    want = [("by", "<=>", *none), ("by", "each", *same), ("map", "each", *same), ("not", "each", *same), ("sum", "each", "instance", "Hash", None), ("most", "each", "instance", None, None), ("sort", "each", "instance", None, None), ("sort", "<=>", *item)]
    want += [("ask", "respond_to_missing?", "instance", "Own", None), ("open", "to_s", *none), ("put", "to_s", *item), ("put", "to_s", *none), ("put", "to_s", *none)]
    assert got == sorted(want, key=repr)
    ids = {(r.parent_site, r.message, r.receiver_name): r.site for r in out.collect()}
    again = {(r.parent_site, r.message, r.receiver_name): r.site for r in derived.implied(sites.orderBy(F.desc("site")), one("found"), one("known")).collect()}
    assert ids == again and out.select("site").distinct().count() == 13


def test_derived_sites_keep_protocol_methods_alive(spark):
    rest = (False, False, None, None, None)
    nodes = spark.createDataFrame([("main", "instance_method", "App", "main", "public", False), ("cmp", "instance_method", "Item", "<=>", "public", False), ("old", "instance_method", "Old", "<=>", "public", False)], NODE)
    sites = spark.createDataFrame([("s", "main", "sort", "instance", "Array", *rest, None, ("container", True, None, "array", ("instance_types", True, ["Item"])), None, None, None)], FACT_SITE)
    classes = spark.createDataFrame([klass("App"), klass("Item"), klass("Old")], CLASS)
    facts = analyzers.Facts(nodes, sites, classes, spark.createDataFrame([("runtime", "main")], ROOT), spark.createDataFrame([("Item",)], "owner string"))
    analysis = analyzers.run(facts)
    assert {r.node for r in analysis.reached.collect()} == {"main", "cmp"}
    rows = analysis.ledger.table("sites").collect()
    assert sorted(r.message for r in rows) == ["<=>", "each"] and {r.parent_call_site_id for r in rows} == {"s"}


def _graph(rng, n, m):
    return {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}


def _frame(spark, pairs, names):
    return spark.createDataFrame(sorted(pairs), ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("seed", range(5))
def test_changed_graphs_beside_full_runs(spark, seed):
    """Random edges and roots come and go: the same nodes as a full run, each below a root by edges that are there."""
    rng = random.Random(seed)
    edges = _graph(rng, 40, 55)
    after = {e for e in edges if rng.random() > 0.15} | _graph(rng, 40, 8 if seed else 0)
    roots = {("runtime", f"n{rng.randrange(40)}") for _ in range(4)} | {("test", f"n{rng.randrange(40)}") for _ in range(2)}
    new_roots = {r for r in roots if rng.random() > 0.3} | {("test", "n1")}
    ends, places = ("src", "dst"), ("domain", "node")
    before = fixpoint.reach(_frame(spark, edges, ends), _frame(spark, roots, places))
    full = {(r.domain, r.node) for r in fixpoint.reach(_frame(spark, after, ends), _frame(spark, new_roots, places)).collect()}
    graph, removed, added = incremental.edge_delta(_frame(spark, edges, ends), _frame(spark, after, ends))
    got, changed = incremental.update_reach(before, graph, removed, added, _frame(spark, new_roots, places))
    rows = got.collect()
    assert len(rows) == len(full) and {(r.domain, r.node) for r in rows} == full
    pred = {(r.domain, r.node): r.pred for r in rows}
    for domain, node in full:
        steps = 0
        while pred[domain, node] is not None:
            assert (pred[domain, node], node) in after
            node, steps = pred[domain, node], steps + 1
            assert steps <= 40
        assert (domain, node) in new_roots
    old = {(r.domain, r.node) for r in before.collect()}
    assert {(r.domain, r.node, r.change) for r in changed.collect()} == {(*x, "lost") for x in old - full} | {(*x, "gained") for x in full - old}


def test_long_superclass_lines(spark, monkeypatch):
    """A thousand classes in a line: few rounds, and the chain of the last one in order."""
    rounds = []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or real(df))
    rows = [klass("K0")] + [klass(f"K{i}", f"K{i - 1}", includes=["M"] if i == 500 else []) for i in range(1, 1000)] + [klass("M", kind="module")]
    got = chains.method_chains(spark.createDataFrame(rows, CLASS), spark.createDataFrame([("K999",)], "owner string")).orderBy("pos").collect()
    assert [r.candidate for r in got] == [f"K{i}" for i in range(999, 499, -1)] + ["M"] + [f"K{i}" for i in range(499, -1, -1)]
    assert len(rounds) <= 30  # five doublings of two, four tables each, and the modules' walk


def test_changed_edges_are_made_once(spark):
    """However many rounds a change takes, the rows of the edges are made once."""
    made_rows = spark.sparkContext.accumulator(0)

    def told(name):
        made_rows.add(1)
        return name

    raw = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    edges = raw.withColumn("src", F.udf(told)("src"))
    before = spark.createDataFrame([("d", "n0", None), ("d", "z", "n0")], "domain string, node string, pred string")
    removed, added = spark.createDataFrame([("n0", "z")], "src string, dst string"), raw.limit(1)
    _, changed = incremental.update_reach(before, edges, removed, added, spark.createDataFrame([("d", "n0")], ROOT))
    assert {(r.node, r.change) for r in changed.collect()} == {("z", "lost")} | {(f"n{i}", "gained") for i in range(1, 7)}
    assert made_rows.value <= 12
