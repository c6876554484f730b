"""Fact-graph analytics on Spark: lookup, reachability, blockers, classification, diffs and metrics over DataFrames."""
