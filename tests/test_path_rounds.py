"""What rounds of witness paths shuffle."""

from measure import shuffled_rows
from pyspark.sql import functions as F

from factloom.operators import fixpoint

HOPS = 6


def test_paths_are_walked_once(spark):
    """5,000 lines of six links each."""
    links = spark.range(5000 * HOPS).selectExpr("concat(id % 5000, '_', id div 5000) as src", "concat(id % 5000, '_', id div 5000 + 1) as dst")
    lines = links.unionByName(links), spark.range(5000).selectExpr("'d' as domain", "concat(id, '_0') as node")
    reached = fixpoint.reach(*lines)
    got = []
    assert shuffled_rows(spark, lambda: got.append(fixpoint.witness_paths(reached, reached).groupBy(F.size("path")).count().collect())) < 450_000
    assert sorted(tuple(r) for r in got[0]) == [(i + 1, 5000) for i in range(HOPS + 1)]
