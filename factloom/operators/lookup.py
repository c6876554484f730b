"""Reference resolution as joins: definition lookup, ordered owner chains, bounded name fallback, runtime references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.ranges import null_safe


def definition_lookup(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, status, n_targets, target): symbol matches come before an exact definition id.

    ``refs`` (ref); ``nodes`` (definition_id, symbol_id). status: unique, ambiguous (by symbol), exact (by id) or missing;
    target is the one definition, NULL unless unique or exact.
    """
    wanted = refs.select("ref").distinct()
    symbols = nodes.groupBy(F.col("symbol_id").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.min("definition_id").alias("by_symbol"))
    ids = nodes.select(F.col("definition_id").alias("ref"), F.col("definition_id").alias("by_id")).distinct()
    hit = wanted.join(symbols, "ref", "left").join(ids, "ref", "left")
    status = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").when(F.col("by_id").isNotNull(), "exact").otherwise("missing")
    target = F.when(F.col("n") == 1, F.col("by_symbol")).when(F.col("n").isNull(), F.col("by_id"))
    n = F.coalesce("n", F.when(F.col("by_id").isNotNull(), 1), F.lit(0)).cast("long")
    return hit.select("ref", status.alias("status"), n.alias("n_targets"), target.alias("target"))


def edges_of(evidence: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, orphans): evidence rows whose two ends are known, and the other rows. ``evidence`` has caller_id and callee_id."""
    known = lambda name: nodes.select(F.col("definition_id").alias(name), F.lit(True).alias(f"_{name}")).distinct()
    tagged = evidence.join(known("caller_id"), "caller_id", "left").join(known("callee_id"), "callee_id", "left")
    both = F.col("_caller_id").isNotNull() & F.col("_callee_id").isNotNull()
    return tagged.filter(both).select(*evidence.columns), tagged.filter(~both).select(*evidence.columns)


def ordered_lookup(sites: DataFrame, chains: DataFrame, methods: DataFrame, only: Column | None = None) -> DataFrame:
    """All definitions at the first owner of a site's chain that defines the message (ties stay: rank, not row_number).

    ``sites`` (site, owner, message), a row each; ``chains`` (owner, pos, candidate); ``methods`` (candidate, message, definition_id).
    ``only``: a condition on the places of a chain that count. What equal sites ask is looked up once; sites and answers meet in
    the last join, so their pairs are neither shuffled nor sorted.
    """
    keys = [c for c in sites.columns if c != "site"]
    asked = sites.select(*keys).filter("owner is not null and message is not null").distinct()
    places = asked.join(chains, "owner")
    found = (places if only is None else places.filter(only)).join(methods, ["candidate", "message"])
    first = Window.partitionBy(*keys).orderBy("pos")
    return null_safe(sites, found.withColumn("_rank", F.rank().over(first)).filter("_rank = 1").drop("_rank"), keys)


def name_fallback(names: DataFrame, limit: int | None = 4) -> DataFrame:
    """(name, definition_id) of names with at most ``limit`` definitions; None: no limit. Counts join back, so a hot name
    is one partial count and no window."""
    few = names.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    few = few if limit is None else few.filter(F.col("_n") <= limit)
    return names.join(few.select("name"), "name", "left_semi")


def ambiguity(names: DataFrame, limit: int) -> DataFrame:
    """(name, n_definitions, exceeded)."""
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("n_definitions"))
    return counted.withColumn("exceeded", F.col("n_definitions") > limit)


ASKED = ["_m", "_s", "_f", "_l"]  # keys of ``asked`` and ``narrowings``


def asked(symbol: Column, file: Column, line: Column) -> list[Column]:
    """The keys under which a reference finds the nodes of its symbol, narrowed by the file and line that it gives (NULL: any)."""
    way = F.when(file.isNotNull(), 1).otherwise(0) + F.when(line.isNotNull(), 2).otherwise(0)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [way.alias("_m"), symbol.alias("_s"), text(file).alias("_f"), text(line).alias("_l")]


def narrowings(nodes: DataFrame) -> DataFrame:
    """(definition_id, ASKED): a node (definition_id, symbol_id, file, line) under each of the up to four keys that may ask for it."""
    none = F.lit(None)
    file, line = F.col("file"), F.col("line")
    ways = [(none, none, F.lit(True)), (file, none, file.isNotNull()), (none, line, line.isNotNull()), (file, line, file.isNotNull() & line.isNotNull())]
    keys = F.array_compact(F.array(*[F.when(there, F.struct(*asked(F.col("symbol_id"), f, n))) for f, n, there in ways]))
    return nodes.filter("symbol_id is not null").select("definition_id", F.explode(keys).alias("_k")).select("definition_id", "_k.*")


def narrowed_counts(nodes: DataFrame) -> DataFrame:
    """(ASKED, _n, _target): how many nodes each key finds, and the smallest; a hot symbol is one row, however many nodes have it."""
    return narrowings(nodes).groupBy(*ASKED).agg(F.count(F.lit(1)).alias("_n"), F.min("definition_id").alias("_target"))


def runtime_reference(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, status, target): a symbol narrowed by the file and line that a reference gives (NULL: any).

    ``refs`` (ref, symbol_id, file, line), ``nodes`` (definition_id, symbol_id, file, line). Nodes are counted before references
    meet them: no pair of a reference and a node is formed.
    """
    keyed = refs.select("ref", *asked(F.col("symbol_id"), F.col("file"), F.col("line")))
    counted = keyed.join(narrowed_counts(nodes), ASKED).groupBy("ref").agg(F.sum("_n").alias("_n"), F.min("_target").alias("_target"))
    joined = refs.select("ref").join(counted, "ref", "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "unique").otherwise("ambiguous")
    return joined.select("ref", status.alias("status"), F.when(F.col("_n") == 1, F.col("_target")).alias("target"))
