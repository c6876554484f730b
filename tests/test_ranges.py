"""Ordered work over range partitions, glob keys and the difference of reports, beside plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.scalars import glob_keys, glob_regex
from factloom.operators import blockers, guard, metrics, ranges, runtime


@pytest.fixture
def narrow(spark):
    """More range partitions than groups, so that groups are split."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_distribution_of_split_groups(narrow):
    rng = random.Random(5)
    values = [(g, round(rng.gauss(0, 50), rng.choice([0, 3]))) for g in ["a"] * 900 + ["b"] * 40 + [None] * 30 + ["c"] for _ in (0, 1)] + [("d", None), ("a", None)]
    df = narrow.createDataFrame(values, "g string, v double").repartition(3)
    got = {r.g: r for r in metrics.distribution(df, ["g"], "v", (1, 50, 95, 100)).collect()}
    groups = {g: sorted(v for k, v in values if k == g and v is not None) for g in {g for g, _ in values}}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        vs = groups[g]
        assert (r.n, r.low, r.high) == (len(vs), vs[0], vs[-1]) and math.isclose(r["mean"], sum(vs) / len(vs), abs_tol=1e-4)
        for p in (1, 50, 95, 100):
            assert r[f"p{p}"] == vs[max(math.ceil(len(vs) * p / 100), 1) - 1]


def test_large_groups_lie_in_many_partitions(narrow):
    cells = ranges.ranged(narrow.range(5000).select(F.lit("x").alias("g"), F.col("id").alias("v")), ["g"], ["v"])
    sizes = [r["count"] for r in cells.groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 2500


def test_as_of_and_parents_beside_brute_force(narrow):
    rng = random.Random(1)
    left = [(i, rng.choice(["hot", "hot", "hot", "k", None]), rng.randrange(200)) for i in range(400)]
    right = [(k, t, rng.choice([t * 10 + ord(k[0]), None])) for k in ("hot", "k", "q") for t in rng.sample(range(200), 60)]
    lf, rf = narrow.createDataFrame(left, "i int, k string, t int"), narrow.createDataFrame(right, "k string, u int, v int")
    got = {r.i: r.latest_v for r in runtime.as_of(lf, rf, "k", "t", "u", "v").collect()}
    for i, k, t in left:
        seen = [(u, v) for kk, u, v in right if kk == k and u <= t and v is not None]
        assert got[i] == (max(seen)[1] if seen else None)
    calls = [(rng.choice(["hot", "hot", "t"]), i, rng.choice("abc")) for i in range(500)]
    want = Counter()
    for key in ("hot", "t"):
        names = [n for k, _, n in calls if k == key]
        want.update(zip(names, names[1:]))
    got = runtime.parent_edges(narrow.createDataFrame(calls, "th string, seq int, name string").repartition(5), "th", ["seq"])
    assert {(r.parent, r.child): r.n for r in got.collect()} == dict(want)


def test_glob_keys_never_lose_a_match():
    rng = random.Random(2)
    parts = ["a", "b", "lib/", "**/", "*", "?", "[ab]", "[!a]", "{a,b}", "{x*,lib/{a,b}}", ".rb", "::", "{", "]", "/"]
    values = ["".join(rng.choice(["a", "b", "lib/", "/", "x", ".rb", "::", "{", "]"]) for _ in range(rng.randrange(7))) for _ in range(400)]
    matched = 0
    for _ in range(600):
        glob = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        keys, pattern = glob_keys(glob), re.compile(glob_regex(glob))
        for v in values:
            if pattern.match(v):
                matched += 1
                assert any(side == "a" or (v[:n] == text if side == "p" else v[-n:] == text) for side, n, text in keys), (glob, v, keys)
    assert matched > 1000
    assert glob_keys("lib/**/x.rb") == [("p", 4, "lib/")] and glob_keys("**/x.rb") == [("s", 4, "x.rb")] and glob_keys("*a*") == [("a", 0, "")]
    assert glob_keys("{" + "a," * 100 + "b}*") == [("a", 0, "")]


def test_many_globs_without_a_nested_loop(spark):
    globs = [(f"g{i}", "file", f"lib/m{i}/*", "glob") for i in range(3000)] + [("any", "owner", "*7*", "glob"), ("end", "message", "*?_to_s", "glob")]
    rules = spark.createDataFrame(globs, "blocker_id string, scope_kind string, scope_value string, scope_match string")
    n = F.col("id").cast("string")
    nodes = spark.range(400).select(n.alias("definition_id"), n.alias("symbol_id"), F.concat(n, F.lit("_to_s")).alias("name"), F.concat(F.lit("O"), n).alias("owner"), F.concat(F.lit("lib/m"), n, F.lit("/x.rb")).alias("file"), F.array().cast("array<string>").alias("namespaces"))
    out = blockers.match(rules, nodes)
    got = Counter(r.blocker_id[0] for r in out.collect())
    assert got == {"g": 400, "a": sum("7" in str(i) for i in range(400)), "e": 400}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cascade_counts_before_it_joins(spark):
    cols = "definition_id string, body_digest string, symbol_id string, path string, classification string"
    entries = spark.createDataFrame([(i, f"old{i}", None, "b", "S", "p", "unreachable") for i in range(50)] + [(99, "d1", "d2", None, "S", "p", "unreachable"), (98, None, "f2", None, None, None, "unreachable"), (97, "d1", None, None, "S", "p", "unused")], "idx int, definition_id string, fingerprint string, body_digest string, symbol_id string, path string, classification string")
    current = spark.createDataFrame([(f"x{i}", f"n{i}", f"q{i}", "c", "S", "p", "unreachable") for i in range(60)] + [("y1", "d1", "d1", "b", "S", "p", "unreachable"), ("y2", "d9", "f2", None, None, None, "unreachable")], "finding string, definition_id string, physical_fingerprint string, " + cols.split(", ", 1)[1])
    got = {r.idx: (r.strategy, r.n_candidates, r.finding) for r in guard.baseline_cascade(entries, current).collect()}
    assert got[99] == ("exact", 1, "y1") and got[98] == ("exact", 1, "y2") and got[97] == ("unmatched", 0, None)
    assert all(got[i] == ("body_digest", 1, "y1") for i in range(50))
