"""Value facts: a fixpoint over a bounded lattice, and what it tells about callables.

A fact is nothing yet, a kind with at most eight values, or unknown. Where several facts meet, unknown ones, different kinds and
more than eight values make an unknown one; else values are united. Facts only grow, so a variable changes ten times at most,
however long or circular the flow is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.common import bucketed, cut, request

ATOMS = 8  # values of a fact at most
FEW = 100_000  # facts of a frontier that are broadcast at most
UNKNOWN = "unknown"
FACT = "var string, kind string, values array<string>, nilable boolean, reason string"


def join_facts(facts: DataFrame) -> DataFrame:
    """One fact (var, kind, values, nilable, reason) for each variable of ``facts`` (var, kind, values, exact, nilable).

    kind is unknown with reason unknown_join (an unknown or inexact fact), mixed_join (several kinds) or atom_budget (more than
    eight values). Values are counted before they are gathered: no variable gathers more than eight.
    """
    told = _met(facts)
    return told.select("var", *_fact(~F.col("_sure"), F.col("_low") != F.col("_high"), F.col("_n") > ATOMS, F.col("_low"), F.col("_values"), F.col("nilable")))


def _met(facts: DataFrame) -> DataFrame:
    """(var, _sure, _low, _high, _n, _values, nilable): what meets in each variable, read once. _n, the number of values, holds where all
    are sure and of one kind, and values are gathered only where it holds and they are few."""
    sure = F.coalesce((F.col("kind") != UNKNOWN) & F.coalesce("exact", F.lit(False)), F.lit(False))
    rows = facts.select("var", "kind", sure.alias("_s"), F.coalesce("nilable", F.lit(False)).alias("_nil"), F.explode_outer("values").alias("_a"))
    each = rows.groupBy("var", "kind", "_a").agg(F.min("_s").alias("_s"), F.max("_nil").alias("_nil"))
    of = Window.partitionBy("var")
    told = {"_sure": F.min("_s"), "_low": F.min("kind"), "_high": F.max("kind"), "_n": F.count("_a"), "nilable": F.max("_nil")}
    heads = each.select("var", "_a", *[c.over(of).alias(k) for k, c in told.items()])
    few = F.col("_sure") & (F.col("_low") == F.col("_high")) & (F.col("_n") <= ATOMS)
    return heads.groupBy("var", *told).agg(F.array_sort(F.collect_list(F.when(few, F.col("_a")))).alias("_values"))


def _fact(unsure: Column, mixed: Column, many: Column, kind: Column, values: Column, nilable: Column) -> list[Column]:
    """kind, values, nilable and reason of a fact."""
    reason = F.when(unsure, "unknown_join").when(mixed, "mixed_join").when(many, "atom_budget")
    none = F.array().cast("array<string>")
    return [F.when(reason.isNull(), kind).otherwise(UNKNOWN).alias("kind"), F.when(reason.isNull(), F.coalesce(values, none)).otherwise(none).alias("values"), nilable.alias("nilable"), reason.alias("reason")]


def value_facts(seeds: DataFrame, flows: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(var, kind, values, nilable, reason) of all variables that a fact reaches: the least solution of var = join of its sources.

    ``seeds`` (var, kind, values, exact, nilable): what is written down; ``flows`` (src, dst), which may repeat: dst may hold what src
    holds. A round joins the changed facts with their flows once, and what meets in a variable with its fact so far.
    """
    with bucketed(flows.select("src", "dst").filter("src is not null and dst is not null and src <> dst"), "src") as edges:
        return _rounds(seeds, edges, max_rounds)


def _rounds(seeds: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    known = cut(join_facts(seeds))
    frontier, n = known, known.count()
    same = ["kind", "values", "nilable"]
    for _ in range(max_rounds):
        at = frontier.select(F.col("var").alias("src"), *same)
        sent = edges.join(F.broadcast(at) if n <= FEW else at.hint("shuffle_hash"), "src").select(F.col("dst").alias("var"), *same, F.lit(True).alias("exact"))
        both = _met(sent).join(known.select("var", F.struct(*same).alias("_old")), "var", "left")
        old, was = F.col("_old"), F.col("_old").isNotNull()
        values = F.when(was, F.array_sort(F.array_union("_values", old["values"]))).otherwise(F.col("_values"))
        mixed = (F.col("_low") != F.col("_high")) | (was & (F.col("_low") != old["kind"]))
        fact = _fact(~F.col("_sure") | (was & (old["kind"] == UNKNOWN)), mixed, (F.col("_n") > ATOMS) | (F.size(values) > ATOMS), F.col("_low"), values, F.col("nilable") | F.coalesce(old["nilable"], F.lit(False)))
        frontier = cut(both.select("var", "_old", *fact).filter(~F.struct(*same).eqNullSafe(old)).drop("_old"))
        n = frontier.count()
        if not n:
            return known
        known = cut(known.join(frontier.select("var"), "var", "left_anti").unionByName(frontier))
    raise RuntimeError("value_facts did not settle")


def callables(sites: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lookups, targets): calls of stored methods: site, status, reason; site, definition_id.

    ``sites`` (site, caller_id, names, reflective, receiver_kind, receiver_values): the fact's names, and where they were taken
    from; a block or lambda (not reflective) has no definition. ``nodes`` (definition_id, kind, owner, name). Owners are the
    receivers' or the caller's; a constant has singleton methods, an instance has its own, a bare receiver what its caller is.
    complete: as many targets as names. A site is one row; what several sites ask is looked up once, and targets are a join of
    sites and answers.
    """
    callers = nodes.select(F.col("definition_id").alias("caller_id"), F.col("owner").alias("_owner"), F.col("kind").alias("_kind"))
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.filter(F.coalesce("names", none), lambda n: F.coalesce(n != "", F.lit(False))))
    rows = sites.withColumn("_names", names).join(callers, "caller_id", "left")
    owners = F.when(F.size(F.coalesce("receiver_values", none)) > 0, F.col("receiver_values")).otherwise(F.array_compact(F.array("_owner")))
    own = F.when(F.col("_kind") == "singleton_method", F.array(F.lit("singleton_method"))).otherwise(F.array(F.lit("instance_method")))
    kinds = F.when(F.col("receiver_kind") == "constant", F.array(F.lit("singleton_method"))).when(F.col("receiver_kind") == "instance", F.array(F.lit("instance_method"))).otherwise(own)
    rows = rows.withColumns({"_o": owners, "_k": kinds}).withColumn("_asked", F.when(F.col("reflective"), request(["_names", "_o", "_k"])))
    rows = cut(rows.select("site", "reflective", "_asked", "_names", "_o", "_k"))
    asked = rows.filter("_asked is not null").select("_asked", "_names", "_o", "_k").dropDuplicates(["_asked"]).select("_asked", F.explode("_names").alias("name"), "_o", "_k")
    asked = asked.select("_asked", "name", F.explode("_o").alias("owner"), "_k").select("_asked", "name", "owner", F.explode("_k").alias("kind"))
    answers = cut(asked.join(nodes.select("definition_id", "kind", "owner", "name"), ["kind", "owner", "name"]).select("_asked", "definition_id").distinct())
    hit = answers.groupBy("_asked").agg(F.count(F.lit(1)).alias("_hit"))
    told = rows.select("site", "reflective", "_asked", F.size("_names").alias("_n")).join(hit, "_asked", "left")
    targets = rows.select("site", "_asked").join(answers, "_asked").select("site", "definition_id")
    reason = F.when(~F.coalesce("reflective", F.lit(False)), "literal_callable_invocation").when(F.col("_n") == 0, "callable_invocation_dynamic_name").when(F.col("_hit").isNull(), "callable_invocation_missing").otherwise("callable_invocation")
    status = F.when(F.col("_hit").isNull(), "unknown").when(F.col("_hit") == F.col("_n"), "complete").otherwise("partial")
    return told.select("site", status.alias("status"), reason.alias("reason")), targets
