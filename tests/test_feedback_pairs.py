"""feedback: both sides are shuffled once, and null keys are equal, as in its SQL."""

from factloom.operators import guard
from measure import shuffled_rows


def test_feedback_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        static = spark.range(400).selectExpr("id a", "id % 7 b")
        observed = spark.range(200, 600).selectExpr("id a", "id % 7 b")
        act = lambda: guard.feedback(static, observed, ["a", "b"]).write.format("noop").mode("overwrite").save()
        assert shuffled_rows(spark, act) <= 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feedback_null_keys_are_equal(spark):
    pair = "a int, b string"
    static = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (None, None)], pair)
    observed = spark.createDataFrame([(1, None), (3, "y"), (3, "y"), (None, "z")], pair)
    got = guard.feedback(static, observed, ["a", "b"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(2, "x", "unobserved"), (None, None, "unobserved"), (3, "y", "missing_static"), (None, "z", "missing_static")]))
