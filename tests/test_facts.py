"""Value facts beside a plain fixpoint, callables, and canonical texts beside a plain writer of them."""

import hashlib
import json
import random

import pytest
from measure import shuffled_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import canonical
from factloom.operators import flow

SEED = "var string, kind string, values array<string>, exact boolean, nilable boolean"


def _joined(facts):
    if any(k == "unknown" or not e for k, _, e, _ in facts):
        return "unknown", (), any(n for *_, n in facts), "unknown_join"
    nil = any(n for *_, n in facts)
    if len({k for k, *_ in facts}) > 1:
        return "unknown", (), nil, "mixed_join"
    values = tuple(sorted({v for _, vs, _, _ in facts for v in vs}))
    return ("unknown", (), nil, "atom_budget") if len(values) > 8 else (facts[0][0], values, nil, None)


def _solve(seeds, flows):
    own = {}
    for var, *fact in seeds:
        own.setdefault(var, []).append(tuple(fact))
    state = {v: _joined(f) for v, f in own.items()}
    while True:
        new = {}
        for var in {d for _, d in flows} | set(own):
            facts = list(own.get(var, [])) + [(state[s][0], state[s][1], True, state[s][2]) for s, d in flows if d == var and s in state and s != var]
            if facts:
                new[var] = _joined(facts)
        if {v: f[:3] for v, f in new.items()} == {v: f[:3] for v, f in state.items()}:
            return new
        state = new


@pytest.mark.parametrize("seed", range(3))
def test_value_facts_beside_a_plain_fixpoint(spark, seed):
    rng = random.Random(seed)
    seeds = [(f"v{rng.randrange(30)}", rng.choice(["instance_types"] * 8 + ["class_object"]), [f"T{rng.randrange(12)}" for _ in range(rng.randrange(4))], rng.random() > 0.05, rng.random() < 0.2) for _ in range(14)]
    flows = {(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(32)}
    got = flow.value_facts(spark.createDataFrame(seeds, SEED), spark.createDataFrame(sorted(flows), "src string, dst string"))
    want = _solve(seeds, flows)
    assert {r["var"]: (r["kind"], tuple(r["values"]), r["nilable"]) for r in got.collect()} == {v: f[:3] for v, f in want.items()}


def test_reasons(spark):
    rows = [("many", "k", [str(i)], True, False) for i in range(9)] + [("mixed", "k", ["a"], True, False), ("mixed", "j", ["a"], True, True), ("loose", "k", ["a"], False, False), ("fine", "k", ["b", "a"], True, False), ("fine", "k", ["a", None], True, None), ("bare", "nil", [], True, True)]
    got = {r["var"]: (r["kind"], r["values"], r["nilable"], r["reason"]) for r in flow.join_facts(spark.createDataFrame(rows, SEED)).collect()}
    assert got == {"many": ("unknown", [], False, "atom_budget"), "mixed": ("unknown", [], True, "mixed_join"), "loose": ("unknown", [], False, "unknown_join"), "fine": ("k", ["a", "b"], False, None), "bare": ("nil", [], True, None)}


def test_callables(spark):
    nodes = spark.createDataFrame([("m", "instance_method", "A", "go"), ("s", "singleton_method", "A", "go"), ("b", "instance_method", "B", "go"), ("c", "instance_method", "A", "main")], "definition_id string, kind string, owner string, name string")
    sites = spark.createDataFrame([(1, "c", ["go"], True, "self", None), (2, "c", ["go", "nope"], True, "constant", ["A"]), (3, "c", ["go"], True, "instance", ["A", "B"]), (4, "c", [], True, "self", None), (5, "c", ["x"], True, "self", None), (6, "c", None, False, None, None)], "site int, caller_id string, names array<string>, reflective boolean, receiver_kind string, receiver_values array<string>")
    lookups, targets = flow.callables(sites, nodes)
    assert {r.site: (r.status, r.reason) for r in lookups.collect()} == {1: ("complete", "callable_invocation"), 2: ("partial", "callable_invocation"), 3: ("partial", "callable_invocation"), 4: ("unknown", "callable_invocation_dynamic_name"), 5: ("unknown", "callable_invocation_missing"), 6: ("unknown", "literal_callable_invocation")}
    assert sorted((r.site, r.definition_id) for r in targets.collect()) == [(1, "m"), (2, "s"), (3, "b"), (3, "m")]


def test_equal_callables_are_looked_up_once(spark):
    """500 equal calls of 200 methods: their statuses come from one count, and no pair is shuffled."""
    nodes = spark.range(200).selectExpr("concat('d', id) as definition_id", "'instance_method' as kind", "'A' as owner", "'go' as name")
    sites = spark.range(500).selectExpr("id as site", "'c' as caller_id", "array('go') as names", "true as reflective", "'instance' as receiver_kind", "array('A') as receiver_values")
    got = []

    def act():
        lookups, targets = flow.callables(sites, nodes)
        got.extend([lookups.groupBy("status").count().collect(), targets.count()])

    assert shuffled_rows(spark, act) < 10_000
    assert [tuple(r) for r in got[0]] == [("partial", 500)] and got[1] == 100_000


def plain(v):
    if v is None:
        return '["nil"]'
    if isinstance(v, bool):
        return f'["boolean",{json.dumps(v)}]'
    if isinstance(v, int):
        return f'["integer","{v}"]'
    if isinstance(v, float):
        r = repr(v)
        return f'["float","{r if "e" not in r or "." in r.split("e")[0] else r.replace("e", ".0e")}"]'
    if isinstance(v, str):
        return f'["string",["UTF-8","{v.encode().hex()}"]]'
    if isinstance(v, list):
        return '["array",[' + ",".join(map(plain, v)) + "]]"
    return '["hash",[' + ",".join(sorted(f"[{plain(k)},{plain(x)}]" for k, x in v.items())) + "]]"


def test_dump_beside_a_plain_writer(spark):
    kind = T.StructType.fromDDL("b boolean, n long, d double, s string, a array<array<string>>, m map<string,map<string,int>>, t struct<z:int,a:string>")
    rows = [
        (True, -5, 1.5, "é\"'[", [["a"], [], [None]], {"b": {"y": 1, "x": None}, "a": {}}, (1, "q")),
        (False, 2**62, 12345678.9, "", [], {}, (None, None)),
        (None, 0, 0.0001, None, None, None, None),
        (True, 1, 1e16, "a,b", [["]]"]], {"a": {}, "b": {"x": None, "y": 1}}, (0, "")),
        (True, 1, -2.5e-7, "x", None, None, None),
        (True, 1, 0.001, "x", None, None, None),
        (True, 1, 1e15, "x", None, None, None),
        (True, 1, 1e22, "x", None, None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(canonical.dump(F.struct(*kind.names), kind)).collect()]
    as_dict = lambda r: dict(zip(kind.names, r)) | {"t": None if r[-1] is None else dict(zip("za", r[-1]))}
    assert got == [plain(as_dict(r)) for r in rows]


def test_dump_of_permuted_maps_and_limits(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 2, 'a', 1) as y, 'text' as s, double('inf') as i")
    m = T.MapType(T.StringType(), T.IntegerType())
    assert df.select(canonical.dump(F.col("x"), m) == canonical.dump(F.col("y"), m)).first()[0]
    for bad in (canonical.dump(F.col("s"), T.StringType(), string_bytes=3), canonical.dump(F.col("x"), m, total_bytes=50), canonical.dump(F.col("i"), T.DoubleType())):
        with pytest.raises(Exception, match="canonical text"):
            df.select(bad).collect()
    with pytest.raises(TypeError):
        canonical.dump(F.col("s"), T.DateType())


def test_call_site_ids(spark):
    sha = lambda *parts: "call:v1:" + hashlib.sha256(plain(list(parts)).encode()).hexdigest()
    df = spark.createDataFrame([("c1", "a.rb", "call", "go", "d", 2, None), ("c1", "a.rb", "super", "go", None, 1, "x:1")], "caller string, path string, role string, message string, digest string, ordinal long, discriminator string")
    c = F.col
    got = df.select(canonical.source_call_id(c("caller"), c("path"), c("role"), c("message"), c("digest"), c("ordinal")), canonical.derived_call_id(c("path"), "rta_implicit", c("caller"), c("message"), c("discriminator"))).collect()
    assert got[0][0] == sha("source", "c1", "a.rb", "call", "go", "d", 2) and got[1][0] == sha("source", "c1", "a.rb", "super", "go", "", 1)
    assert got[0][1] == sha("derived", "rta_implicit", "a.rb", "c1", "go") and got[1][1] == sha("derived", "rta_implicit", "a.rb", "c1", "go", "x:1")
    meta = T.MapType(T.StringType(), T.StringType())
    site = F.struct(F.lit("c").alias("caller_id"), F.lit("m").alias("message"), F.lit("self").alias("receiver_kind"), F.lit(None).cast("string").alias("receiver_name"), F.lit("f").alias("file"), F.lit(3).alias("line"), F.lit(False).alias("test"), F.lit(True).alias("dynamic"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    assert df.limit(1).select(canonical.legacy_call_id(site, meta)).first()[0] == sha("legacy", "c", "m", "self", None, "f", 3, False, True, {"k": "v"})
    with pytest.raises(Exception, match="no role"):
        df.select(canonical.source_call_id(c("caller"), c("path"), F.lit("other"), c("message"), c("digest"), c("ordinal"))).collect()
