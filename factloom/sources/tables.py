"""Fact graphs derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) over whole tables: customer, order, part, supplier, nation, region, each to the next; lines may repeat a link."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    parts = [
        edge(t("orders"), "C", "o_custkey", "O", "o_orderkey"),
        edge(t("lineitem"), "O", "l_orderkey", "P", "l_partkey"),
        edge(t("lineitem"), "P", "l_partkey", "S", "l_suppkey"),
        edge(t("supplier"), "S", "s_suppkey", "N", "s_nationkey"),
        edge(t("nation"), "N", "n_nationkey", "R", "n_regionkey"),
    ]
    return reduce(DataFrame.unionByName, parts)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the links, each once."""
    return supply_links(spark, sf_dir).distinct()


def supply_roots(spark: SparkSession, sf_dir: str, domains: dict[str, int]) -> DataFrame:
    """(domain, node): customers of one nation for each domain."""
    customers = table(spark, sf_dir, "customer")
    return reduce(DataFrame.unionByName, [customers.filter(F.col("c_nationkey") == n).select(F.lit(d).alias("domain"), F.concat(F.lit("C"), "c_custkey").alias("node")) for d, n in domains.items()])


def supply_sinks(spark: SparkSession, sf_dir: str, nation: int) -> DataFrame:
    """(node): suppliers of one nation."""
    return table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") == nation).select(F.concat(F.lit("S"), "s_suppkey").alias("node"))


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"customer": ("C", "c_custkey"), "orders": ("O", "o_orderkey"), "part": ("P", "p_partkey"), "supplier": ("S", "s_suppkey")}
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.concat(F.lit(k), c).alias("node")) for t, (k, c) in names.items()])
