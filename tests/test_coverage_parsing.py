"""coverage_files: texts are parsed a fixed few times, not again in each expression and filter that names them."""

from factloom.operators import observe


def test_payloads_are_parsed_once(spark):
    rows = [(1, '{"coverage": {"a.rb": [0, 2, null]}, "runtime": {"files": {"b.rb": {"lines": {"3": 1, "4": 0}}}}}'), (2, '{"c.rb": {"coverage": [1, 2]}, "d.rb": 5}'), (3, "[1]"), (4, None), (5, '{"files": [1, 2'), (6, '{"e.rb": [1, ')]
    found = observe.coverage_files(spark.createDataFrame(rows, "run int, payload string"))
    got = sorted(tuple(r) for r in found.collect())
    assert got[:4] == [(1, "a.rb", 2), (1, "b.rb", 3), (2, "c.rb", 1), (2, "c.rb", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json(") <= 8
