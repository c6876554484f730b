"""Candidate summaries on small fixtures."""

from factloom.operators import evaluate


def test_sums_and_sets(spark):
    names = "candidate_count candidate_loc diagnostic_count blocked_count unknown_count resolution_total resolution_unknown".split()
    parts = spark.createDataFrame([(3, 30, 1, 1, 0, 4, 1), (1, 5, 3, 1, 2, 4, 1)], ", ".join(f"{n} int" for n in names))
    got = evaluate.aggregate_quality(parts).first()
    assert tuple(got)[:5] == (4, 35, 4, 2, 2) and [float(x) for x in tuple(got)[5:]] == [0.25, 0.25, 0.25]
    assert [float(x) for x in tuple(evaluate.aggregate_quality(parts.limit(0)).first())[5:]] == [0, 0, 0]
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},), (None,)], "m map<string,int>")
    assert {r.value: r.n for r in evaluate.merged_tallies(maps, "m").collect()} == {"a": 4, "b": 2}
    cols = "definition_id string, is_candidate boolean, is_blocked boolean"
    base, mutant = spark.createDataFrame([("x", True, False), ("y", False, False)], cols), spark.createDataFrame([("x", True, True), ("y", True, False)], cols)
    assert sorted(map(tuple, evaluate.safety_violations(base, mutant).collect())) == [("x", "blocked_candidate"), ("y", "added_candidate")]


def test_class_sample(spark):
    classes = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    whole, few = evaluate.instantiated_sample(classes).first(), evaluate.instantiated_sample(classes, limit=1, few=1).first()
    assert (whole.n, whole["sample"], few["sample"]) == (2, ["a", "b"], ["a"]) and whole.digest == few.digest
    assert evaluate.instantiated_sample(classes.limit(0)).first().n == 0
