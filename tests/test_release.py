"""Release audit, precedence of edges, rollups and choices on small rows with nulls, ties and empty tables."""

import duckdb

from factloom.operators import adjacency, release
from factloom.plans.queries import ORACLE_SQL, QUERIES

FINDING = "corpus string, definition_id string, id string, state string, confidence string, actionability string, candidate boolean"
LABEL = "corpus string, target string, label struct<value:string,rationale:string,reviewer:string>"
REVIEW = "corpus string, change string, target string, review struct<outcome:string,rationale:string,reviewer:string>"


def _reports(spark):
    before = [("a", "d1", "i1", "alive", "low", None, None), ("a", "d2", "i2", "unused", "high", None, None), ("a", None, "i3", "unused", "low", "diagnostic", None)]
    after = [("a", "d1", "i1", "unused", "certain", None, None), ("a", None, "i3", "unused", "high", None, False), ("a", "d4", "i4", "alive", "high", None, True), ("a", "d5", "i5", "unused", None, None, None)]
    return spark.createDataFrame(before, FINDING), spark.createDataFrame(after, FINDING)


def test_changes(spark):
    got = {(r.change, r.identity, r.before_state, r.after_state) for r in release.compare(*_reports(spark)).collect()}
    assert got == {
        ("state_changed", "d1", "alive", "unused"), ("confidence_changed", "d1", "alive", "unused"), ("removed", "d2", "unused", None), ("confidence_changed", "i3", "unused", "unused"),
        ("actionability_changed", "i3", "unused", "unused"), ("added", "d4", None, "alive"), ("added", "d5", None, "unused"),
    }
    empty = _reports(spark)[0].limit(0)
    assert release.compare(empty, empty).count() == 0 and release.repeated_names(empty).count() == 0


def test_new_strong_candidates_and_gates(spark):
    labels = spark.createDataFrame([("a", "d1", ("alive", "why", "me")), ("a", "i1", ("dead", "why", "me")), ("a", "i4", ("dead", " ", "me"))], LABEL)
    new = release.newly_high(*_reports(spark), labels)
    assert {(r.identity, r.label and r.label.value, r.match) for r in new.collect()} == {("d1", "alive", "physical"), ("d4", "dead", "logical")}
    policies = spark.createDataFrame([("a", None)], "corpus string, minimum int")
    reviews = spark.createDataFrame([("a", "added", "d4", ("false_positive", "x", "me")), ("a", "added", "i4", ("expected_safety_change", "x", "me")), ("a", "removed", "i2", ("odd", "x", "me"))], REVIEW)
    required = release.required_reviews(release.compare(*_reports(spark)), policies)
    reviewed = release.review_status(required, reviews)
    assert {(r.change, r.identity, r.status) for r in reviewed.collect()} == {("state_changed", "d1", "missing"), ("removed", "d2", "invalid"), ("added", "d4", "completed"), ("added", "d5", "missing")}
    checks = spark.createDataFrame([("performance", True), ("performance", None), ("public_claim", True)], "gate string, passed boolean")
    got = {r.gate: (r.passed, r.failures) for r in release.release_gates(new, reviewed, checks).collect()}
    assert got == {
        "new_high_reviewed": (False, 1), "new_high_false_positives": (False, 1), "new_high_unresolved": (True, 0), "difference_review": (False, 3), "review_false_positives": (False, 1),
        "performance": (False, 1), "adversarial": (True, 0), "public_claim": (True, 0),
    }


def test_samples_of_strata(spark):
    rows = [("a", "added", f"d{i}", f"d{i}", f"i{i:02}", None, "unused" if i % 2 else None) for i in range(20)] + [("b", "added", "x", None, "x", None, "unused"), ("c", "added", "y", None, "y", None, "unused")]
    changes = spark.createDataFrame(rows, "corpus string, change string, identity string, definition_id string, id string, before_state string, after_state string")
    policies = spark.createDataFrame([("a", 3), ("b", 0)], "corpus string, minimum int")
    assert {r.id for r in release.required_reviews(changes, policies).collect()} == {"i00", "i01", "i02", "i03", "i04", "i05"}
    assert release.required_reviews(changes, policies.filter("corpus = 'b'")).count() == 0
    assert release.required_reviews(changes, policies.limit(0)).count() == 0


def test_queue_predicate(spark):
    rows = [("a", None, "1", "unused", "high", "diagnostic", True), ("a", None, "2", "alive", "low", "review_candidate", False), ("a", None, "3", "unused", "high", None, None), ("a", None, "4", "alive", None, None, True), ("a", None, "5", None, None, None, None)]
    df = spark.createDataFrame(rows, FINDING)
    assert {r.id: r.c for r in df.filter(release.reviewable()).select("id", release.review_class().alias("c")).collect()} == {"2": "review_candidate", "3": "high_candidate", "4": "candidate"}


def test_preferred_edges(spark):
    new = spark.createDataFrame([("a", "b"), (None, "c")], "caller string, callee string")
    old = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "c"), ("a", "c")], "caller string, callee string")
    got = sorted(map(str, [tuple(r) for r in adjacency.preferred_edges(new, old).collect()]))
    assert got == sorted(map(str, [("a", "b", "structured"), (None, "c", "structured"), ("a", "c", "legacy"), ("a", "c", "legacy"), (None, "c", "legacy")]))


def test_first_known_and_skips(spark):
    groups = spark.createDataFrame([(1, ["x", "k", "j"]), (2, ["x", "y"]), (3, []), (4, None), (5, [None, "k"])], "g int, candidates array<string>")
    known = spark.createDataFrame([("k",), ("j",), ("k",)], "candidate string")
    assert {r.g: r.candidate for r in adjacency.first_known(groups, known, ["g"]).collect()} == {1: "k", 2: "x", 5: "k"}
    files = spark.createDataFrame([("a", "large"), ("b", None), ("c", "large"), ("d", "binary")], "file string, reason string")
    assert {r.reason: r.n for r in adjacency.skip_counts(files).collect()} == {"large": 2, "binary": 1}


def test_first_known_names_where_all_three_names_are_customers(spark, tmp_path):
    """Beyond 100,000 customers the first name may be known too: query and SQL state the same rule there."""
    customers = spark.createDataFrame([(1, 5.0), (8, -1.0), (9, 5.0), (100001, 5.0), (100008, 5.0), (100009, -1.0), (2, -1.0)], "c_custkey long, c_acctbal double")
    orders = spark.createDataFrame([(1, 1), (2, 8), (3, 9), (4, 2), (5, 15), (6, 700)], "o_orderkey long, o_custkey long")
    for name, df in (("customer", customers), ("orders", orders)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {1: 100001, 2: 100008, 3: 9, 4: 100002, 5: 1, 6: 100700}
    assert {r.site: r.candidate for r in QUERIES["first_known_names"](spark, str(tmp_path)).collect()} == want
    assert dict(con.execute(ORACLE_SQL["first_known_names"]).fetchall()) == want
