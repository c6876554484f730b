"""Entry points as filters over fact tables: (definition_id, domain, reason) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import glob_regex, matches_any

METHODS = ("instance_method", "singleton_method")


def _roots(rows: DataFrame, domain: str, reason: str) -> DataFrame:
    return rows.select("definition_id", F.lit(domain).alias("domain"), F.lit(reason).alias("reason"))


def script_roots(nodes: DataFrame, globs: list[str]) -> DataFrame:
    """Top-level code outside tests in files that match a script pattern."""
    return _roots(nodes.filter("kind = 'block_entry'").filter(~F.coalesce("test", F.lit(False))).filter(matches_any(F.col("file"), globs)), "runtime", "main_script")


def declared_roots(nodes: DataFrame, patterns: list[str], library: bool = False) -> DataFrame:
    """Definitions outside tests whose symbol matches a configured pattern (``*`` crosses every character)."""
    if not patterns:
        return _roots(nodes.limit(0), "runtime", "public_api_declared")
    loose = "|".join(glob_regex(p).replace("[^/]", ".") for p in patterns)
    return _roots(nodes.filter(~F.coalesce("test", F.lit(False))).filter(F.col("symbol_id").rlike(loose)), "external" if library else "runtime", "public_api_declared")


def library_file_roots(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Public singleton methods of a gem's primary files (file)."""
    return _roots(nodes.filter("kind = 'singleton_method' and visibility = 'public'").join(files.select("file").distinct(), "file", "left_semi"), "runtime", "public_api_declared")


def test_roots(nodes: DataFrame) -> DataFrame:
    return _roots(nodes.filter("kind = 'block_entry' and test"), "test", "test_suite")


test_roots.__test__ = False  # not a test of pytest


def library_surface(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, blockers) of a library: public and protected methods may be called from outside, and are blocked as such."""
    surface = nodes.filter(F.col("kind").isin(*METHODS)).filter(~F.coalesce("test", F.lit(False))).filter("visibility in ('public', 'protected')")
    scope = [F.lit("definition").alias("scope_kind"), F.col("definition_id").alias("scope_value"), F.lit("exact").alias("scope_match"), F.lit("implicit").alias("receiver_kind")]
    blockers = surface.select(F.concat(F.lit("open_public_api:"), "definition_id").alias("blocker_id"), F.lit("open_public_api").alias("kind"), *scope)
    return _roots(surface, "external", "library_public_api"), blockers


def load_roots(nodes: DataFrame) -> DataFrame:
    """Every file's top-level code outside tests, where all files count as loaded."""
    return _roots(nodes.filter("kind = 'block_entry'").filter(~F.coalesce("test", F.lit(False))), "runtime", "production_load_unit")


def merged(*parts: DataFrame) -> DataFrame:
    """All roots, equal ones once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def unrooted_units(nodes: DataFrame, reached: DataFrame, calls: DataFrame, limit: int = 50) -> DataFrame:
    """(n_units, files): files whose top-level code outside tests makes calls but is not reached; the first ``limit`` by name.

    ``reached`` (definition_id), ``calls`` (caller_id).
    """
    units = nodes.filter("kind = 'block_entry'").filter(~F.coalesce("test", F.lit(False))).join(reached.select("definition_id"), "definition_id", "left_anti")
    units = units.join(calls.select(F.col("caller_id").alias("definition_id")), "definition_id", "left_semi").select("file").distinct()
    ordered = units.orderBy("file").limit(limit).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return units.agg(F.count(F.lit(1)).alias("n_units")).crossJoin(ordered)
