"""Import of runtime observations on small fixtures."""

import json

import pytest
from measure import shuffled_rows
from pyspark.sql import functions as F

from factloom.operators import lookup, observe


def test_payload_shapes(spark):
    rows = [
        (1, json.dumps({"files": {"a.rb": [0, 2, None, 1]}, "runtime": {"a.rb": {"9": 1}}})),
        (2, json.dumps({"production": {"files": {"b.rb": {"lines": {"3": 1, "4": 0}}}}})),
        (3, json.dumps({"lib/c.rb": [5, 7, 5]})),
        (4, json.dumps({"coverage": {"d.rb": {"coverage": [0, 1]}, "e.rb": "text"}})),
        (5, "[1]"), (6, None), (7, "{}"),
    ]
    got = observe.coverage_files(spark.createDataFrame(rows, "run int, payload string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a.rb", 2), (1, "a.rb", 4), (1, "a.rb", 9), (2, "b.rb", 3), (3, "lib/c.rb", 5), (3, "lib/c.rb", 7), (4, "d.rb", 2)]


def test_counts_and_observations(spark):
    one = spark.range(1)
    m = F.create_map(F.lit("0"), F.lit("3"), F.lit("2"), F.lit("x"))
    got = one.select(observe.dense_counts(m, F.lit(4)).alias("a"), observe.dense_counts(m, F.lit(0)).alias("b"), observe.merged_counts(F.array(F.lit(1), F.lit(None).cast("int")), F.array(F.lit(2), F.lit(None).cast("int"), F.lit(5))).alias("c")).first()
    assert got.a == [3, None, None, None] and got.b == [] and got.c == [3, None, 5]
    left = F.create_map(F.lit("environment"), F.lit("ci"), F.lit("x"), F.lit("1"))
    merge = lambda env: one.select(observe.merged_observation(left, F.create_map(F.lit("environment"), F.lit(env), F.lit("x"), F.lit("2"))).alias("m")).first().m
    assert merge("ci") == {"environment": "ci", "x": "2"}
    with pytest.raises(Exception, match="incompatible observations: environment"):
        merge("prod")


def test_references_and_resolution(spark):
    nodes = spark.createDataFrame([("d1", "A#x", "a.rb", 1), ("d2", "A#x", "b.rb", 5), ("d3", "B#y", "b.rb", 9)], "definition_id string, symbol_id string, file string, line int")
    values = ['"A#x"', '"B#y"', '"d2"', '"no"', '{"symbol_id": "A#x", "definition_id": "d1"}', '{"symbol_id": "B#y", "definition_id": "d1"}', '{"symbol_id": "A#x", "definition_id": "d3", "file": "b.rb"}', '{"symbol_id": "A#x", "line": 7}', '{"symbol_id": ""}', '{"symbol_id": "A#x", "line": "z"}', "[]", None]
    read = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ref int, value string").select("ref", observe.reference(F.col("value")).alias("r"))
    assert {r.ref for r in read.filter("r is null").collect()} == {8, 9, 10, 11}
    resolved = observe.resolve(read.filter("r is not null").select("ref", "r.*"), nodes)
    got = sorted(tuple(r) for r in resolved.collect())
    assert got == [(0, "ambiguous", "d1"), (0, "ambiguous", "d2"), (1, "unique", "d3"), (2, "exact", "d2"), (3, "missing", None), (4, "exact", "d1"), (5, "missing", None), (6, "unique", "d2"), (7, "missing", None)]
    edges = spark.createDataFrame([(1, 1, 4), (2, 0, 1), (3, 3, 7)], "edge int, caller int, callee int")
    seen = observe.observed_edges(edges, resolved)
    assert sorted(tuple(r) for r in seen.collect()) == [(1, "d3", "d1", "matched"), (2, None, None, "partially_matched"), (3, None, None, "unmatched")]
    counts = {r.kind: tuple(r)[1:] for r in observe.match_counts(resolved, seen).collect()}
    assert counts == {"nodes": (8, 4, 1, 3), "edges": (3, 1, 1, 1)}


def test_imports(spark):
    nodes = spark.createDataFrame([("d1", "A#x", "a.rb", 1), ("d2", "A#x", "b.rb", 5), ("d3", "B#y", "b.rb", 9)], "definition_id string, symbol_id string, file string, line int")
    structured = spark.createDataFrame([('{"symbol_id": "A#x", "file": "a.rb"}',), ("7",)], "value string")
    legacy = spark.createDataFrame([("A#x",), ("B#y",)], "symbol_id string")
    seen, bad = observe.import_references(structured, legacy, nodes, "coverage")
    assert sorted(r.definition_id for r in seen.collect()) == ["d1", "d3"] and [r.value for r in bad.collect()] == ["7"]
    spans = spark.createDataFrame([("d1", "a.rb", 1, 9), ("d2", "a.rb", 4, 5), ("d3", "b.rb", 1, 2)], "definition_id string, file string, first int, last int")
    covered = spark.createDataFrame([("/app/a.rb", 4), ("/app/a.rb", 90)], "path string, line int")
    ids, many = observe.import_lines(covered, spark.createDataFrame([("d9",)], "definition_id string"), spans)
    assert sorted(r.definition_id for r in ids.collect()) == ["d1", "d2", "d9"]
    assert [tuple(r) for r in many.collect()] == [("a.rb", 4, ["d1", "d2"])]


def test_hot_symbols_are_counted_before_references_meet_them(spark):
    """400 references to a symbol of 400 nodes are 160,000 pairs; ends and edges come from counts, and no pair is shuffled."""
    nodes = spark.range(400).selectExpr("concat('d', id) as definition_id", "'A#x' as symbol_id", "concat('f', id % 3) as file", "if(id % 7 = 0, null, cast(id % 5 as int)) as line")
    none = "cast(null as string) as"
    refs = spark.range(400).selectExpr("id as ref", f"{none} identifier", f"{none} definition_id", "'A#x' as symbol_id", "if(id % 2 = 0, concat('f', id % 4), null) as file", "if(id % 3 = 0, cast(id % 6 as int), null) as line")
    parts = {r.definition_id: (r.file, r.line) for r in nodes.collect()}
    fits = {r.ref: sorted(d for d, (f, n) in parts.items() if r.file in (None, f) and r.line in (None, n)) for r in refs.collect()}
    state = lambda found: "missing" if not found else "unique" if len(found) == 1 else "ambiguous"
    want = {(ref, state(found), d) for ref, found in fits.items() for d in found or [None]}
    got, ends, seen, narrow = [], [], [], []
    edges = spark.range(400).selectExpr("id as edge", "id as caller", "id as callee")
    assert shuffled_rows(spark, lambda: got.extend(observe.resolve(refs, nodes).collect())) < 40_000
    assert shuffled_rows(spark, lambda: ends.extend(observe.resolve_ends(refs, nodes).collect())) < 20_000
    assert shuffled_rows(spark, lambda: seen.extend(observe.observed_edges(edges, observe.resolve_ends(refs, nodes)).collect())) < 20_000
    assert shuffled_rows(spark, lambda: narrow.extend(lookup.runtime_reference(refs, nodes).collect())) < 20_000
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in ends} == {(ref, state(found), min(found, default=None)) for ref, found in fits.items()}
    assert {tuple(r) for r in narrow} == {(ref, state(found), found[0] if len(found) == 1 else None) for ref, found in fits.items()}
    assert len(seen) == 400 and {r.match for r in seen} == {"partially_matched"}
