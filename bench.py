"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from factloom.plans.queries import QUERIES

HEADLINE = [
    "classify_findings", "reach_multi_domain", "evidence_dedupe", "evidence_collisions", "resolution_conflicts", "ordered_lookup_first_match", "blocker_match_scopes",
    "line_interval_join", "feedback_pairs", "distribution_p95_nearest_rank", "text_token_join", "diff_full_outer", "topk_per_definition", "asof_latest_before",
]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["set_ops"](spark, sf).count()  # starts the JVM's code paths; not timed
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
