"""What rounds of value facts shuffle."""

from measure import shuffled_rows
from pyspark.sql import functions as F

from factloom.operators import flow
from factloom.plans import coverage_queries

HOPS = 6


def test_flows_are_joined_once_a_round(spark, monkeypatch):
    """5,000 lines of six flows each, every flow twice; no frontier is broadcast."""
    monkeypatch.setattr(flow, "FEW", 0, raising=False)
    flows = spark.range(5000 * HOPS).selectExpr("concat(id % 5000, '_', id div 5000) as src", "concat(id % 5000, '_', id div 5000 + 1) as dst")
    flows, starts = flows.unionByName(flows), spark.range(5000).selectExpr("concat(id, '_0') as node")
    seeds = starts.select(F.col("node").alias("var"), F.lit("k").alias("kind"), F.array("node").alias("values"), F.lit(True).alias("exact"), F.lit(False).alias("nilable"))
    got = []
    assert shuffled_rows(spark, lambda: got.append(flow.value_facts(seeds, flows).groupBy("kind", F.size("values")).count().collect())) < 500_000
    assert [tuple(r) for r in got[0]] == [("k", 1, 5000 * (HOPS + 1))]


def test_every_line_of_an_order_flows(spark, tmp_path):
    """An order's second line brings what its part holds."""
    given = {"lineitem": "1 as l_orderkey, id + 1 as l_partkey, id + 1 as l_suppkey, int(id + 1) as l_linenumber", "orders": "1 as o_orderkey, 1 as o_custkey", "supplier": "id + 1 as s_suppkey, int(id + 1) as s_nationkey"}
    for name, columns in given.items():
        spark.range(1 if name == "orders" else 2).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    told = {r["var"]: (r["kind"], r["vals"]) for r in coverage_queries.value_facts(spark, str(tmp_path)).collect()}
    assert told["O1"] == told["C1"] == ("instance_types", "N1,N2")
    assert told["P2"] == ("instance_types", "N2")
