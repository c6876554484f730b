"""What rounds of reach shuffle."""

import pytest
from measure import shuffled_rows

from factloom.operators import fixpoint

HOPS = 6


@pytest.fixture
def lines(spark):
    """5,000 lines of six links each, every link twice, and their starts."""
    links = spark.range(5000 * HOPS).selectExpr("concat(id % 5000, '_', id div 5000) as src", "concat(id % 5000, '_', id div 5000 + 1) as dst")
    return links.unionByName(links), spark.range(5000).selectExpr("'d' as domain", "concat(id, '_0') as node")


@pytest.mark.parametrize("preds", [True, False])
def test_edges_are_shuffled_once(spark, lines, monkeypatch, preds):
    """60,000 edges, repeated ones too; no frontier is broadcast. Rounds shuffle what they reach."""
    monkeypatch.setattr(fixpoint, "FEW", 0)
    edges, roots = lines
    got = []
    assert shuffled_rows(spark, lambda: got.append(fixpoint.reach(edges, roots, preds=preds).groupBy("hops").count().collect())) < 300_000
    assert sorted(tuple(r) for r in got[0]) == [(i, 5000) for i in range(HOPS + 1)]
    assert not spark.catalog.listTables()


def test_reach_without_predecessors(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("x", "c"), (None, "y"), ("c", None)], "src string, dst string")
    roots = spark.createDataFrame([("runtime", "a"), ("test", "x")], "domain string, node string")
    got = fixpoint.reach(edges, roots, preds=False)
    assert got.columns == ["domain", "node", "hops"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, fixpoint.reach(edges, roots).select(*got.columns).collect()), key=repr)
