"""Lookup chains and the call-site dispatcher, beside a walk in Python and on hand-made rows."""

import random

from measure import shuffled_rows

from factloom.operators import chains, dispatch

CLASS = "id string, kind string, superclass string, includes array<string>, prepends array<string>, singleton_includes array<string>, singleton_prepends array<string>, dynamic boolean"
SITE = "site int, caller_id string, message string, receiver_kind string, receiver_name string, dynamic boolean, test boolean, physical_target string, flow_types array<string>, original string"
NODE = "definition_id string, kind string, owner string, name string, visibility string, test boolean"


def klass(name, above=None, includes=(), prepends=(), sin=(), sprep=(), kind="class", dynamic=False):
    return (name, kind, above, list(includes), list(prepends), list(sin), list(sprep), dynamic)


def chain(info, owner, seen):
    if owner is None or owner in seen:
        return []
    seen.add(owner)
    if owner not in info:
        return [owner]
    c = info[owner]
    before = [x for n in reversed(c[4]) for x in chain(info, n, seen)]
    after = [x for n in reversed(c[3]) for x in chain(info, n, seen)]
    return before + [owner] + after + chain(info, c[2], seen)


def singleton(info, owner, seen):
    if owner is None or owner in seen:
        return []
    seen.add(owner)
    if owner not in info:
        return [(owner, ".")]
    c = info[owner]
    ext = lambda names: [(x, "#") for n in reversed(names) for x in chain(info, n, set())]
    return ext(c[6]) + [(owner, ".")] + ext(c[5]) + singleton(info, c[2], seen)


def test_chains_without_circles(spark):
    """Random classes and modules that only name later ones: the same chains by lines and modules as by a walk."""
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"K{i}" for i in range(24)]
        later = lambda i, n: [rng.choice(names[i + 1 :]) for _ in range(rng.randint(0, n))] if i < 22 else []
        rows = [klass(n, rng.choice([None, *names[i + 1 : i + 4]]) if i < 20 else None, later(i, 2), later(i, 1)) for i, n in enumerate(names)]
        info = {r[0]: r for r in rows}
        got = {}
        for r in chains.method_chains(spark.createDataFrame(rows, CLASS)).orderBy("owner", "pos").collect():
            got.setdefault(r.owner, []).append(r.candidate)
        assert got == {n: chain(info, n, set()) for n in info}


def test_chains_beside_a_walk(spark):
    rng = random.Random(3)
    names = [f"K{i}" for i in range(14)] + ["Out"]
    pick = lambda n: [rng.choice(names) for _ in range(rng.randint(0, n))]
    rows = [klass(n, rng.choice([None, *names]), pick(3), pick(2), pick(2), pick(1)) for n in names[:-1]]
    info = {r[0]: r for r in rows}
    df = spark.createDataFrame(rows, CLASS)
    got = {}
    for r in chains.method_chains(df).orderBy("owner", "pos").collect():
        got.setdefault(r.owner, []).append(r.candidate)
    assert got == {n: chain(info, n, set()) for n in info}
    got = {}
    for r in chains.singleton_chains(df).orderBy("owner", "pos").collect():
        got.setdefault(r.owner, []).append((r.candidate, r.sep))
    assert got == {n: singleton(info, n, set()) for n in info}
    want = {}
    for n in info:
        line, now = [], info[n][2]
        while now and now not in line:
            line.append(now)
            now = info[now][2] if now in info else None
        want[n] = line
    got = {n: [] for n in info}
    for r in chains.ancestors(df).orderBy("owner", "pos").collect():
        got[r.owner].append(r.candidate)
    assert got == want
    below = {(a, d) for d in info for a in [d, *want[d]] if a in info}
    assert {(r.owner, r.candidate) for r in chains.descendants(df).collect()} == below
    assert {(r.ancestor, r.owner) for r in chains.reachable_owners(df).collect()} == {(a, o) for a, d in below for o in chain(info, d, set())}


def test_dispatcher(spark):
    classes = spark.createDataFrame(
        [klass("Base"), klass("Mid", "Base", ["Mix"]), klass("Leaf", "Mid"), klass("Mix", kind="module"), klass("Dyn", "Base", dynamic=True), klass("Open", "Gone"), klass("Ext", sin=["Mix"]), klass("Ghost"), klass("Kin", "Base")], CLASS
    )
    method = lambda i, owner, name, kind="instance_method", vis="public", test=False: (i, kind, owner, name, vis, test)
    nodes = spark.createDataFrame(
        [
            method("base_run", "Base", "run"), method("mix_run", "Mix", "run"), method("leaf_run", "Leaf", "run"), method("leaf_go", "Leaf", "go"), method("base_make", "Base", "make", "singleton_method"),
            method("dyn_x", "Dyn", "x"), method("gone_y", "Gone", "y"), method("ghost_mm", "Ghost", "method_missing"), method("base_secret", "Base", "secret", vis="private"), method("base_guard", "Base", "guard", vis="protected"),
            method("kin_go", "Kin", "kin_go"), *[method(f"many{i}", f"C{i}", "many") for i in range(5)], method("test_only", "T", "helper", test=True), method("again1", "Leaf", "again"), method("again2", "Leaf", "again"),
        ],
        NODE,
    )
    sites = [
        (1, "leaf_go", "run", "instance", "Leaf"), (2, "leaf_go", "run", "super", None), (3, "leaf_run", "run", "super", None), (4, "leaf_go", "make", "constant", "Leaf"), (5, "leaf_go", "x", "instance", "Dyn"),
        (6, "leaf_go", "y", "instance", "Open"), (7, "leaf_go", "anything", "instance", "Ghost"), (8, "leaf_go", "secret", "instance", "Base"), (9, "leaf_go", "secret", "implicit", None), (10, "leaf_go", "guard", "instance", "Kin"),
        (11, "ghost_mm", "guard", "instance", "Kin"), (12, "nobody", "guard", "instance", "Kin"), (13, "leaf_go", "many", "unknown", None), (14, "leaf_go", "kin_go", "implicit", None), (15, "leaf_go", "helper", "unknown", None),
        (16, "mix_run", "run", "super", None), (17, "leaf_go", "run", "constant", "Ext"), (18, "leaf_go", "again", "instance", "Leaf"), (19, "leaf_go", "absent", "instance", "Leaf"),
    ]
    rows = [(i, c, m, k, o, False, False, None, None, None) for i, c, m, k, o in sites]
    rows += [(20, "leaf_go", "run", "instance", "Leaf", True, False, None, None, None), (21, "leaf_go", "q", "unknown", None, False, False, "dyn_x", None, None), (22, "leaf_go", "q", "unknown", None, False, False, "nope", None, None)]
    rows += [(23, "leaf_go", "run", "unknown", None, False, False, None, ["Leaf", "Base"], None), (24, "leaf_go", "run", "unknown", None, False, False, None, ["Leaf", "Ghost2"], None), (25, "leaf_go", "helper", "unknown", None, False, True, None, None, None)]
    lookups, targets, rejected = dispatch.method_lookup(spark.createDataFrame(rows, SITE), nodes, classes)
    state = {r.site: r.status for r in lookups.collect()}
    assert lookups.count() == len(rows)
    hit, out = {i: set() for i in state}, {i: set() for i in state}
    for r in targets.collect():
        hit[r.site].add(r.definition_id)
    for r in rejected.collect():
        out[r.site].add((r.definition_id, r.reason))
    late = "shadowed_by_lookup_order"
    want = {
        1: ("complete", {"leaf_run"}, {("mix_run", late), ("base_run", late)}), 2: ("complete", {"mix_run"}, {("base_run", late)}), 3: ("complete", {"mix_run"}, {("base_run", late)}), 4: ("complete", {"base_make"}, set()), 5: ("partial", {"dyn_x"}, set()),
        6: ("partial", {"gone_y"}, set()), 7: ("complete", {"ghost_mm"}, set()), 8: ("complete", set(), {("base_secret", "private_visibility")}), 9: ("complete", {"base_secret"}, set()), 10: ("complete", {"base_guard"}, set()),
        11: ("complete", set(), {("base_guard", "protected_visibility")}), 12: ("partial", {"base_guard"}, set()), 13: ("unknown", set(), set()), 14: ("partial", {"kin_go"}, set()), 15: ("unknown", set(), set()),
        16: ("partial", {"base_run"}, set()), 17: ("complete", {"mix_run"}, set()), 18: ("complete", {"again1", "again2"}, set()), 19: ("unknown", set(), set()), 20: ("partial", {"base_run", "mix_run", "leaf_run"}, set()),
        21: ("complete", {"dyn_x"}, set()), 22: ("unknown", set(), set()), 23: ("complete", {"leaf_run", "base_run"}, {("mix_run", late)}), 24: ("partial", {"leaf_run"}, set()), 25: ("partial", {"test_only"}, set()),
    }
    assert {i: (state[i], hit[i], out[i]) for i in state} == want
    assert dispatch.method_lookup(spark.createDataFrame([], SITE), nodes, classes)[0].count() == 0


def test_strategy_is_the_first_rule(spark):
    rows = [(1, True, "d", ["A"], "constant", None, None), (2, False, "d", ["A"], "constant", None, None), (3, False, None, ["A"], "constant", None, None), (4, None, None, [], "constant", None, None), (5, False, None, None, "self", None, None), (6, False, None, None, "self", "A", "block_entry"), (7, False, None, None, None, "A", "x")]
    df = spark.createDataFrame(rows, "i int, dynamic boolean, physical_target string, flow_types array<string>, receiver_kind string, caller_owner string, caller_kind string")
    assert [r.s for r in df.select("i", dispatch.strategy().alias("s")).orderBy("i").collect()] == ["name", "physical", "flow", "singleton", "name", "self_singleton", "name"]


def test_equal_sites_are_dispatched_once(spark):
    """600 equal sites of 200 targets are 120,000 pairs, which come from the last join; statuses and targets shuffle none."""
    classes = spark.createDataFrame([klass("A")], CLASS)
    nodes = spark.range(200).selectExpr("concat('d', id) as definition_id", "'instance_method' as kind", "'A' as owner", "'m' as name", "if(id % 2 = 0, 'private', 'public') as visibility", "false as test")
    sites = spark.range(600).selectExpr("cast(id as int) as site", "'nobody' as caller_id", "'m' as message", "'instance' as receiver_kind", "'A' as receiver_name", "false as dynamic", "false as test", "cast(null as string) as physical_target", "cast(null as array<string>) as flow_types", "cast(null as string) as original")
    got = []

    def act():
        lookups, targets, rejected = dispatch.method_lookup(sites, nodes, classes)
        got.extend([lookups.groupBy("status").count().collect(), targets.count(), rejected.count()])

    assert shuffled_rows(spark, act) < 30_000
    assert [tuple(r) for r in got[0]] == [("complete", 600)] and got[1:] == [60_000, 60_000]
