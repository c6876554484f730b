"""Evidence by its id's columns: plain columns are shuffled once, ids and digests are made afterwards; results are those by id."""

import pytest

from factloom.operators import evidence
from factloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shuffled_bytes(spark, act) -> int:
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def total() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


@pytest.mark.parametrize("name", ["evidence_dedupe", "evidence_collisions", "evidence_collision_blockers"])
def test_a_line_takes_few_bytes(spark, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled_bytes(spark, lambda: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()) < 64 * lines


def test_by_columns_is_by_id(spark):
    rows = [(1, None, "p", "r"), (1, None, "q", "t"), (1, None, "q", None), (2, "x", "p", "r"), (2, "x", "p", "r"), (None, None, None, None), (None, None, "p", "t"), (3, "", "p", "r")]
    df = spark.createDataFrame(rows, "a int, b string, payload string, domain string")
    ids = ["a", "b"]
    plain = evidence.with_payload(df, ids, ["payload"])
    named = lambda d: sorted(map(repr, d.select("evidence_id", *[c for c in ("payload", "domain", "n_payloads") if c in d.columns]).collect()))
    told = lambda d: named(d.withColumn("evidence_id", evidence.identity("evidence:v1", ids)))
    dealt = evidence.by_columns(df, ids, ["payload"])
    assert named(evidence.accepted(plain)) == told(evidence.accepted(dealt, ids))
    assert named(evidence.collisions(plain)) == told(evidence.collisions(dealt, ids))
    want = sorted(map(repr, [("r", 1), ("t", 2), (None, 2)]))
    assert sorted(repr(tuple(r)) for r in evidence.collision_blockers(dealt, "domain", ids).collect()) == want
    assert sorted(repr(tuple(r)) for r in evidence.collision_blockers(plain, "domain").collect()) == want
