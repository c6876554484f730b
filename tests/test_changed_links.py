"""Reachability after a change where nothing is small enough to be broadcast: results, and what is shuffled."""

import random

import pytest
from measure import shuffled_rows

from factloom.operators import fixpoint, incremental

LINK, ROOT = "src string, dst string", "domain string, node string"


@pytest.fixture
def large(monkeypatch):
    for module in (fixpoint, incremental):
        monkeypatch.setattr(module, "FEW", 0)


@pytest.mark.parametrize("seed", range(2))
def test_two_graphs_in_one_table(spark, large, seed):
    rng = random.Random(seed)
    links = lambda n: {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(n)}
    old = links(55)
    new = {e for e in old if rng.random() > 0.15} | links(8)
    was = {("runtime", f"n{rng.randrange(40)}") for _ in range(4)} | {("test", "n2")}
    now = {r for r in was if rng.random() > 0.3} | {("test", "n1")}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    full = [{(r.domain, r.node) for r in fixpoint.reach(frame(e, LINK), frame(r, ROOT)).collect()} for e, r in ((old, was), (new, now))]
    told = [(*e, True, False) for e in old] + [(*e, False, True) for e in new]
    rows = incremental.reach_changes(spark.createDataFrame(told * 2, LINK + ", before boolean, after boolean"), frame(was, ROOT), frame(now, ROOT)).collect()
    assert len(rows) == len(full[0] ^ full[1])
    assert {tuple(r) for r in rows} == {(*x, "lost") for x in full[0] - full[1]} | {(*x, "gained") for x in full[1] - full[0]}


def test_edges_are_shuffled_once(spark, large):
    """50,000 edges, six of which a change follows."""
    far = spark.range(50_000).selectExpr("concat('a', id) as src", "concat('b', id) as dst")
    edges = far.unionByName(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], LINK))
    before = spark.createDataFrame([("d", "n0", None), ("d", "z", "n0")], "domain string, node string, pred string")
    removed, added = spark.createDataFrame([("n0", "z")], LINK), spark.createDataFrame([("n0", "n1")], LINK)
    got = []
    assert shuffled_rows(spark, lambda: got.append(incremental.update_reach(before, edges, removed, added, spark.createDataFrame([("d", "n0")], ROOT))[1].collect())) < 100_000
    assert {(r.node, r.change) for r in got[0]} == {("z", "lost")} | {(f"n{i}", "gained") for i in range(1, 7)}
