"""Rules that a program writes down: tasks read them without Python."""

from factloom.operators import blockers
from factloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rules_of_a_program_need_no_python(spark):
    plan = QUERIES["blocker_match_scopes"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_listed_rules_match_as_a_table_does(spark):
    rules = [("a", "file", "lib/**/x*.rb", "glob"), ("b", "file", "{app,lib}/*", "glob"), ("c", "message", "*o*", "glob"), ("d", "owner", "A", "exact"), ("e", "owner", None, "glob"), ("f", "global", None, "exact")]
    names = ["blocker_id", "scope_kind", "scope_value", "scope_match"]
    nodes = spark.createDataFrame([("1", "s1", "go", "A", "lib/a/x1.rb", ["A"]), ("2", "s2", "run", "B", "app/y", []), ("3", "s3", "do", "A", "lib/x.rb", None)], "definition_id string, symbol_id string, name string, owner string, file string, namespaces array<string>")
    table = spark.createDataFrame(rules, "blocker_id string, scope_kind string, scope_value string, scope_match string")
    want = sorted(map(tuple, blockers.match(table, nodes).collect()))
    assert sorted(map(tuple, blockers.match(blockers.listed(spark, [dict(zip(names, r)) for r in rules]), nodes).collect())) == want and len(want) > 5
