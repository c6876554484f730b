"""The files of a project as sets: from one listing to analyzed, referenced, excluded and doubtful files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import path_filter

#: Fixed names: folders that are never searched, and what counts as source without a scope.
EXCLUDED = (".bundle", ".git", "coverage", "log", "node_modules", "tmp", "vendor")
SOURCE = r"\.(rb|rake|gemspec|ru)$|(^|/)(Rakefile|Gemfile)$"
DEFAULT = r"\.(rb|rake)$|^Rakefile$|^(bin|exe)/[^/]+$|^[^/]+\.gemspec$"
ENTRY = r"^(bin|exe|config|db|script|lib/tasks)/|^config\.ru$|\.rake$|(^|/)Rakefile$"


@dataclass(frozen=True)
class Scopes:
    """Globs: analyze (empty: the usual source files), reference (empty: every file), exclude, and what counts as tests."""

    analyze: tuple[str, ...] = ()
    reference: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    tests: tuple[str, ...] = ("test/**", "spec/**")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of all files below a folder, in any store that Spark reads; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", F.concat(F.lit(r"^[a-z0-9+.-]*:?/*\Q"), F.lit(root), F.lit(r"\E/")), F.lit(""))
    return found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _within(globs: tuple[str, ...]) -> Column:
    return path_filter(F.col("path"), list(globs), []) if globs else F.lit(True)


def universe(files: DataFrame, scopes: Scopes) -> DataFrame:
    """(path, source, test, analyzed, referenced, domain, entry_outside, issue) of files (path and, if known, symlink, error, first_line).

    Files below an excluded folder are left out. source: by name, or by a first line that starts its interpreter. analyzed: source files
    in the analyze scope; referenced: files in the reference scope, or analyzed. domain: analyze, reference or excluded. Links and
    files that could not be looked at are issues and in no set. entry_outside: a source file that is not analyzed though it may
    be an entry point.
    """
    given = lambda c, kind: F.col(c) if c in files.columns else F.lit(None).cast(kind)
    parts = F.split("path", "/")
    rows = files.select("path", F.coalesce(given("symlink", "boolean"), F.lit(False)).alias("_link"), given("error", "string").alias("_error"), given("first_line", "string").alias("_first"))
    skipped = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in EXCLUDED])) | F.coalesce(~path_filter(F.col("path"), [], list(scopes.exclude)), F.lit(False))
    rows = rows.filter("path is not null").dropDuplicates(["path"]).filter(~skipped)
    issue = F.when(F.col("_link"), "symlink").when(F.col("_error").isNotNull(), "inspection_error")
    fine = issue.isNull()
    source = fine & (F.col("path").rlike(SOURCE) | F.coalesce(F.col("_first").rlike(r"^#!.*\bruby\b"), F.lit(False)))
    hidden = F.exists(parts, lambda p: p.startswith("."))
    scoped = _within(scopes.analyze) if scopes.analyze else ~hidden & F.col("path").rlike(DEFAULT)
    analyzed = source & scoped
    referenced = fine & (analyzed | _within(scopes.reference))
    test = path_filter(F.col("path"), list(scopes.tests), []) if scopes.tests else F.lit(False)
    told = rows.select("path", source.alias("source"), test.alias("test"), analyzed.alias("analyzed"), referenced.alias("referenced"), issue.alias("issue"))
    domain = F.when(F.col("analyzed"), "analyze").when(F.col("referenced"), "reference").otherwise("excluded")
    return told.withColumn("domain", domain).withColumn("entry_outside", F.col("source") & ~F.col("analyzed") & F.col("path").rlike(ENTRY))


def scope_diagnostics(files: DataFrame, limit: int = 20) -> DataFrame:
    """One row of a ``universe``: numbers of analyzed and referenced files, of source files outside of both (all, and outside tests) with the first of them, of entry points outside and of issues."""
    outside = F.col("source") & ~F.col("analyzed") & ~F.col("referenced")
    first = F.slice(F.array_sort(F.collect_list("path")), 1, limit)
    samples = files.filter(outside).orderBy("path").limit(limit).agg(first.alias("samples"))
    return files.agg(
        F.count_if("analyzed").alias("n_analyzed"), F.count_if("referenced").alias("n_referenced"), F.count_if(outside).alias("n_outside"), F.count_if(outside & ~F.col("test")).alias("n_outside_runtime"),
        F.count_if("entry_outside").alias("n_entries_outside"), F.count_if(F.col("issue").isNotNull()).alias("n_issues"), F.count_if(F.col("issue").isNotNull() & ~F.col("test")).alias("n_issues_runtime"),
    ).crossJoin(samples)


def scope_blockers(files: DataFrame) -> DataFrame:
    """(blocker_id, kind, scope_kind, scope_value, scope_match, n_files): global blockers of callers or sources that the scopes hide."""
    told = scope_diagnostics(files)
    rows = F.array(F.struct(F.lit("reference_scope_incomplete").alias("kind"), F.col("n_outside_runtime").alias("n_files")), F.struct(F.lit("source_discovery_incomplete").alias("kind"), F.col("n_issues_runtime").alias("n_files")))
    each = told.select(F.explode(rows).alias("r")).select("r.*").filter("n_files > 0")
    return each.select("kind", F.lit("global").alias("scope_kind"), F.lit("*").alias("scope_value"), F.lit("exact").alias("scope_match"), F.concat(F.lit("scope:"), "kind").alias("blocker_id"), "n_files")
