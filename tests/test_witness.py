"""witness_path over every line of lineitem, beside a walk; open paths are never dropped."""

from collections import defaultdict

import pytest

from factloom.operators import fixpoint
from factloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_witness_path_over_all_lines(spark):
    near = defaultdict(set)
    t = lambda name, *cols: spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()
    for a, x, b, y, rows in [("C", 0, "O", 1, t("orders", "o_custkey", "o_orderkey")), ("O", 0, "P", 1, t("lineitem", "l_orderkey", "l_partkey")), ("P", 0, "S", 1, t("lineitem", "l_partkey", "l_suppkey")), ("S", 0, "N", 1, t("supplier", "s_suppkey", "s_nationkey")), ("N", 0, "R", 1, t("nation", "n_nationkey", "n_regionkey"))]:
        for r in rows:
            near[f"{a}{r[x]}"].add(f"{b}{r[y]}")
    level = {f"C{r.c_custkey}" for r in spark.read.parquet(f"{SF}/customer.parquet").filter("c_nationkey = 3").collect()}
    want, hops = {x: (0, None) for x in level}, 0
    while level:
        hops += 1
        following = {y for x in level for y in near[x]} - set(want)
        want |= {y: (hops, min(x for x in level if y in near[x])) for y in following}
        level = following

    def path(x):
        return (path(want[x][1]) if want[x][1] else []) + [x]

    got = QUERIES["witness_path"](spark, SF).collect()
    assert sorted((r.node, r.path, r.length) for r in got) == sorted((x, ">".join(path(x)), want[x][0] + 1) for x in want)


def test_open_paths_raise(spark):
    rows = [(str(i), str(i - 1) if i else None) for i in range(4)]
    reached = spark.createDataFrame(rows, "node string, pred string")
    assert sorted(r.path[0] for r in fixpoint.witness_paths(reached, reached, max_hops=4).collect()) == ["0"] * 4
    with pytest.raises(RuntimeError):
        fixpoint.witness_paths(reached, reached, max_hops=3)
