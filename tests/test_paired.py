"""Joins whose pairs are most of the work: cells of few keys are dealt over the tasks."""

import pytest
import test_dispatch
from pyspark.sql import functions as F
from test_analyzers import made

from factloom.operators import common, observe
from factloom.plans import analyzers

REF = "ref long, identifier string, definition_id string, symbol_id string, file string, line int"
NODE = "definition_id string, symbol_id string, file string, line int"


@pytest.mark.parametrize("wide,tall", [(1, 1), (3, 2), (2048, 4096)])
def test_paired_is_the_join(spark, monkeypatch, wide, tall):
    monkeypatch.setattr(common, "WIDE", wide)
    monkeypatch.setattr(common, "TALL", tall)
    left = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(7)] + [("b", 0), ("c", 1)], "k string, l int")
    right = spark.createDataFrame([("a", "x", f"v{i}") for i in range(5)] + [("b", "x", "v"), ("b", "x", "v"), ("b", "y", None), ("d", "x", "v"), (None, "x", "v")], "k string, s string, v string")
    told = lambda df: sorted(map(str, df.select("k", "l", "s", "v").collect()))
    got = common.paired(left, right, ["k"], "v")
    assert got.columns == ["k", "l", "s", "v"]
    assert told(got) == told(left.join(right, "k"))


def test_references_of_one_symbol_are_many_tasks(spark, monkeypatch):
    """200 references to a symbol of 300 nodes: 60,000 pairs, no task with half of them."""
    monkeypatch.setattr(common, "WIDE", 20, raising=False)
    monkeypatch.setattr(common, "TALL", 30, raising=False)
    refs = spark.createDataFrame([(i, "S", None, None, None, None) for i in range(200)], REF)
    nodes = spark.createDataFrame([(f"n{i}", "S", "f", 1) for i in range(300)], NODE)
    rows = observe.resolve(refs, nodes)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 30_000
    assert rows.filter("status = 'ambiguous'").select("ref", "definition_id").distinct().count() == 60_000


def test_sites_of_one_request_are_many_tasks(spark, monkeypatch):
    """400 equal sites with 150 targets: 60,000 rows, no task with half of them."""
    monkeypatch.setattr(common, "WIDE", 20, raising=False)
    monkeypatch.setattr(common, "TALL", 30, raising=False)
    nodes = spark.createDataFrame([("c", "instance_method", "O", "main", "public", False)], test_dispatch.NODE)
    rest = (False, False, None, None, None)
    sites = spark.createDataFrame([(i, "c", "go", "instance", "O", *rest) for i in range(400)], test_dispatch.SITE)
    facts = made(spark, nodes=nodes, sites=sites).grouped()
    request = facts.members.first()["request"]
    evidence = spark.createDataFrame([("p", request, request, f"t{i}", "exact") for i in range(150)], "producer string, call_site_id string, caller_id string, callee_id string, grade string")
    rows = analyzers.expanded(facts, evidence)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 30_000
    assert rows.filter("caller_id = 'c' and grade = 'exact'").select("call_site_id", "callee_id").distinct().count() == 60_000
