"""Call-site dispatch beyond the ordered lookup: super calls, visibility and arity of the targets found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.chains import method_chains, singleton_chains, superclass_lines
from factloom.operators.common import cut, request
from factloom.operators.lookup import name_fallback, ordered_lookup


def super_lookup(sites: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """Definitions at the first owner after a site's own one in its receiver's chain; ties stay.

    ``sites`` (site, owner, current, message): ``current`` is the owner of the calling method inside the chain of
    ``owner``; ``chains`` and ``methods`` as for the ordered lookup. A ``current`` outside the chain finds nothing; one
    that is there twice counts from its first place. Null keys match nothing.
    """
    places = chains.groupBy("owner", F.col("candidate").alias("current")).agg(F.min("pos").alias("_own"))
    inside = sites.join(places, ["owner", "current"])
    return ordered_lookup(inside, chains, methods, F.col("pos") > F.col("_own")).drop("_own")


def private_rejected(visibility: Column, receiver: Column, original: Column, include_private: Column) -> Column:
    """Whether a private target is out of reach: an explicit receiver, unless the call was reflective.

    NULL visibility is never rejected; a NULL receiver counts as explicit, a NULL ``include_private`` as true.
    """
    bare = F.coalesce(receiver.isin("implicit", "self", "super"), F.lit(False))
    reflective = F.coalesce(original.isin("send", "__send__", "method"), F.lit(False))
    asked = F.coalesce(original == "respond_to?", F.lit(False))
    reached = bare | reflective | (asked & F.coalesce(include_private, F.lit(True)))
    return F.coalesce(visibility == "private", F.lit(False)) & ~reached


def arity_rejected(given: Column, keywords: Column, low: Column, high: Column, required: Column, accepted: Column, keyword_rest: Column) -> Column:
    """Whether arguments cannot fit a signature; keywords given to a target without any count as one more positional.

    ``high`` NULL: any number of positionals. NULL keyword lists count as empty.
    """
    none = F.array().cast("array<string>")
    given_kw, needed, known = (F.coalesce(c, none) for c in (keywords, required, accepted))
    rest = F.coalesce(keyword_rest, F.lit(False))
    takes = rest | (F.size(needed) > 0) | (F.size(known) > 0)
    count = given + F.when((F.size(given_kw) > 0) & ~takes, 1).otherwise(0)
    wrong_count = (count < low) | F.coalesce(count > high, F.lit(False))
    missing = F.size(F.array_except(needed, given_kw)) > 0
    unknown = ~rest & (F.size(F.array_except(given_kw, known)) > 0)
    return wrong_count | (takes & (missing | unknown))


def protected_outcome(sites: DataFrame, chains: DataFrame, classes: DataFrame) -> DataFrame:
    """``sites`` with protected_ok: true, false or NULL (not known) for a protected target, true for any other.

    ``sites`` (caller_owner, receiver_owner, target_owner, visibility, receiver_kind, original): allowed are reflective and
    bare calls; public_send never; else both families must hold the target's owner, if all three owners are known and static.
    """
    static = classes.filter("not dynamic").select(F.col("id").alias("_known"))
    family = chains.select("owner", F.col("candidate").alias("_member")).distinct()
    rows = sites
    for name in ("caller_owner", "receiver_owner", "target_owner"):
        rows = rows.join(static.select(F.col("_known").alias(name), F.lit(True).alias(f"_{name}")), name, "left")
    for name in ("caller_owner", "receiver_owner"):
        members = family.select(F.col("owner").alias(name), F.col("_member").alias("target_owner"), F.lit(True).alias(f"_{name}_in"))
        rows = rows.join(members, [name, "target_owner"], "left")
    known = F.col("_caller_owner").isNotNull() & F.col("_receiver_owner").isNotNull() & F.col("_target_owner").isNotNull()
    inside = F.col("_caller_owner_in").isNotNull() & F.col("_receiver_owner_in").isNotNull()
    outcome = (
        F.when(F.coalesce(F.col("visibility") != "protected", F.lit(True)), F.lit(True))
        .when(F.col("original") == "public_send", F.lit(False))
        .when(F.col("original").isin("send", "__send__", "method") | F.col("receiver_kind").isin("implicit", "super", "self"), F.lit(True))
        .when(known, inside)
    )
    return rows.withColumn("protected_ok", outcome).select(*sites.columns, "protected_ok")


def strategy() -> Column:
    """Which lookup a call site takes: the first rule that holds.

    Columns: dynamic, physical_target, flow_types (array), receiver_kind, caller_owner, caller_kind.
    """
    kind = F.col("receiver_kind")
    own = F.when(F.col("caller_owner").isNull(), "name").when(F.coalesce(F.col("caller_kind") == "instance_method", F.lit(False)), "self_instance").otherwise("self_singleton")
    above = F.when(F.col("caller_owner").isNull(), "name").when(F.col("caller_kind") == "singleton_method", "super_singleton").otherwise("super_instance")
    return (
        F.when(F.coalesce(F.col("dynamic"), F.lit(False)), "name")
        .when(F.col("physical_target").isNotNull(), "physical")
        .when(F.coalesce(F.size("flow_types") > 0, F.lit(False)), "flow")
        .when(kind == "constant", "singleton")
        .when(kind == "instance", "instance")
        .when(kind.isin("self", "implicit"), own)
        .when(kind == "super", above)
        .otherwise("name")
    )


def tagged(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """``entries`` (owner, pos, candidate, sep) with gaps, the owners up to there without a class row, and opened, whether any is dynamic."""
    info = classes.groupBy(F.col("id").alias("candidate")).agg(F.max(F.coalesce(F.col("dynamic").cast("int"), F.lit(0))).alias("_dynamic"))
    told = entries.join(info, "candidate", "left")
    upto = Window.partitionBy("owner").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.sum(F.when(F.col("_dynamic").isNull(), 1).otherwise(0)).over(upto)
    opened = F.max(F.coalesce("_dynamic", F.lit(0))).over(Window.partitionBy("owner")) > 0
    return told.select("owner", "pos", "candidate", "sep", gaps.alias("gaps"), opened.alias("opened"))


def lone_entries(owners: DataFrame, classes: DataFrame, sep: str) -> DataFrame:
    """Tagged entries of owners (owner) without a class row: themselves."""
    missing = owners.select("owner").filter("owner is not null").distinct().join(classes.select(F.col("id").alias("owner")), "owner", "left_anti")
    return missing.select("owner", F.lit(0).alias("pos"), F.col("owner").alias("candidate"), F.lit(sep).alias("sep"), F.lit(1).cast("long").alias("gaps"), F.lit(False).alias("opened"))


def class_entries(classes: DataFrame, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tagged instance and singleton entries of all classes, made once. ``above``: ``chains.superclass_lines``, if they are there."""
    above = superclass_lines(classes) if above is None else above
    return cut(tagged(method_chains(classes, above=above).withColumn("sep", F.lit("#")), classes)), cut(tagged(singleton_chains(classes, above), classes))


def resolve(requests: DataFrame, entries: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner, message, after, definition_id, place, complete, missing): all definitions of a message in an owner's entries.

    ``requests`` (owner, message, after), each once: entries up to position ``after`` don't count (-1: all do). ``entries`` as
    ``tagged`` gives them, ``methods`` (candidate, sep, message, definition_id). place 1: the first owner that defines it (ties
    stay), 2: shadowed by it. complete: every owner up to that one has a class row, and no owner of the entries is
    dynamic. missing: found by method_missing, which is looked for where the message is nowhere, once for an owner and not for
    each message. A message that no method has meets no entry at all.
    """
    names = methods.select("message").distinct()

    def found(wanted: DataFrame) -> DataFrame:
        hit = wanted.join(names, "message", "left_semi").join(entries, "owner").filter(F.col("pos") > F.col("after")).join(methods, ["candidate", "sep", "message"])
        return hit.withColumn("_rank", F.rank().over(Window.partitionBy("owner", "message", "after").orderBy("pos")))

    complete = (F.col("gaps") == 0) & ~F.col("opened")
    direct = cut(found(requests).select("owner", "message", "after", "definition_id", "_rank", complete.alias("_whole")))
    first = Window.partitionBy("owner", "message", "after")
    placed = direct.select("owner", "message", "after", "definition_id", F.when(F.col("_rank") == 1, 1).otherwise(2).alias("place"), F.max(F.when(F.col("_rank") == 1, F.col("_whole"))).over(first).alias("complete"), F.lit(False).alias("missing"))
    lost = requests.join(direct.select("owner", "message", "after"), ["owner", "message", "after"], "left_anti")
    caught = found(lost.select("owner", "after", F.lit("method_missing").alias("message")).distinct()).filter("_rank = 1").select("owner", "after", "definition_id", complete.alias("complete"))
    return placed.unionByName(lost.join(caught, ["owner", "after"]).select("owner", "message", "after", "definition_id", F.lit(1).alias("place"), "complete", F.lit(True).alias("missing")))


def chain_lookup(sites: DataFrame, entries: DataFrame, methods: DataFrame) -> DataFrame:
    """(site, part, definition_id, place, complete, missing): ``resolve`` for sites (site, part, owner, message, after; NULL after: -1).

    ``part`` tells several lookups of a site apart. Each (owner, message, after) is resolved once, however many sites ask.
    """
    asked = sites.select("site", "part", "owner", "message", F.coalesce("after", F.lit(-1)).alias("after"))
    answers = resolve(asked.select("owner", "message", "after").filter("owner is not null").distinct(), entries, methods)
    return asked.join(answers, ["owner", "message", "after"]).select("site", "part", "definition_id", "place", "complete", "missing")


def method_lookup(sites: DataFrame, nodes: DataFrame, classes: DataFrame, limit: int | None = 4, entries: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lookups, targets, rejected) of call sites: site, status, reason; site, definition_id; site, definition_id, reason.

    ``sites`` (site, caller_id, message, receiver_kind, receiver_name, dynamic, test, physical_target, flow_types,
    original); ``nodes`` (definition_id, kind, owner, name, visibility, test); ``classes`` (id, kind, superclass, includes,
    prepends, singleton_includes, singleton_prepends, dynamic). status: complete, partial (targets, but there may be more) or
    unknown. A module's super call is answered by every host and is never complete; several flow types are complete only if
    each is. Complete lookups reject private and protected targets and name what the hit shadows. ``entries``: what
    ``class_entries`` gave for the classes, if it is there already. A site is one row; what several sites ask is looked up once, and
    each result is a join of sites and answers, which nothing shuffles afterwards.
    """
    callers = nodes.select(F.col("definition_id").alias("caller_id"), F.col("owner").alias("caller_owner"), F.col("kind").alias("caller_kind"))
    asks = ["caller_owner", "caller_kind", "message", "receiver_kind", "receiver_name", "dynamic", "test", "physical_target", "flow_types", "original"]
    keyed = sites.join(callers, "caller_id", "left").withColumn("_asked", request(asks))
    rows = cut(keyed.select("_asked", *asks).dropDuplicates(["_asked"])).withColumnRenamed("_asked", "site").withColumn("strategy", strategy())
    told = lambda answers: keyed.select("site", "_asked").join(answers.withColumnRenamed("site", "_asked"), "_asked").drop("_asked")
    sep = F.when(F.col("kind") == "singleton_method", ".").otherwise("#")
    methods = nodes.filter(F.col("kind").isin("instance_method", "singleton_method")).select(F.col("owner").alias("candidate"), sep.alias("sep"), F.col("name").alias("message"), "definition_id", F.coalesce("test", F.lit(False)).alias("_test"))
    plain = methods.drop("_test")
    owner = F.when(F.col("strategy").isin("singleton", "instance"), F.col("receiver_name")).otherwise(F.col("caller_owner"))
    asked = rows.filter("strategy not in ('name', 'physical')").withColumn("owner", owner)
    asked = asked.filter("strategy <> 'flow'").withColumn("part", F.lit("")).unionByName(asked.filter("strategy = 'flow'").withColumn("owner", F.explode(F.array_distinct("flow_types"))).withColumn("part", F.col("owner")))
    asked = cut(asked.select("site", "part", "owner", "message", "strategy"))
    of_instance, of_singleton = entries or class_entries(classes)
    instance = of_instance.unionByName(lone_entries(asked, classes, "#"))
    singleton = of_singleton.unionByName(lone_entries(asked, classes, "."))
    none = F.lit(None).cast("int").alias("after")
    modules = classes.filter("kind = 'module'").select(F.col("id").alias("owner"))
    shared = asked.filter("strategy = 'super_instance'").join(modules, "owner", "left_semi")
    own_place = lambda entries, s: entries.filter((F.col("candidate") == F.col("owner")) & (F.col("sep") == s)).select("owner", F.col("pos").alias("after"))
    above = asked.filter("strategy = 'super_instance'").join(modules, "owner", "left_anti")
    hosts = classes.filter("kind = 'class'").select(F.col("id").alias("owner"))

    def hosted(entries: DataFrame) -> DataFrame:
        """The module's super calls, in every class whose entries hold it."""
        inside = entries.filter("sep = '#'").join(hosts, "owner").select(F.col("owner").alias("_host"), F.col("candidate").alias("owner"), F.col("pos").alias("after"))
        return shared.join(inside, "owner").select("site", F.col("_host").alias("part"), F.col("_host").alias("owner"), "message", "after")

    by_instance = [
        asked.filter("strategy in ('instance', 'self_instance', 'flow')").select("site", "part", "owner", "message", none),
        above.join(own_place(instance, "#"), "owner").select("site", "part", "owner", "message", "after"),
        shared.join(own_place(instance, "#"), "owner").select("site", F.col("owner").alias("part"), "owner", "message", "after"),
        hosted(instance),
    ]
    by_singleton = [
        asked.filter("strategy in ('singleton', 'self_singleton')").select("site", "part", "owner", "message", none),
        asked.filter("strategy = 'super_singleton'").join(own_place(singleton, "."), "owner").select("site", "part", "owner", "message", "after"),
        hosted(singleton),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    found = cut(chain_lookup(union(by_instance), instance, plain).unionByName(chain_lookup(union(by_singleton), singleton, plain)))
    kinds = asked.groupBy("site").agg(F.first("strategy").alias("strategy"), F.count_distinct("part").alias("_parts")).join(shared.select("site", F.lit(True).alias("_open")).distinct(), "site", "left")
    merged = found.groupBy("site").agg(F.count_distinct("part").alias("_hit"), F.min("complete").alias("_complete"), F.max("missing").alias("_missing"))
    state = kinds.join(merged, "site", "left")
    whole = F.coalesce(F.col("_complete"), F.lit(False)) & (F.col("_hit") == F.col("_parts")) & F.col("_open").isNull()
    status = F.when(F.col("_hit").isNull(), "unknown").when(whole, "complete").otherwise("partial")
    reason = F.concat(F.col("strategy"), F.when(F.col("_open").isNotNull(), "_open_hosts").when(F.coalesce(F.col("_missing"), F.lit(False)), "_method_missing").otherwise("_lookup"))
    chained = cut(state.select("site", status.alias("status"), reason.alias("reason"), "strategy"))

    unknown = chained.filter("status = 'unknown' and strategy = 'self_instance'").select("site")
    named = rows.filter("strategy = 'name'").select("site", "message", "test").unionByName(rows.join(unknown, "site", "left_semi").select("site", "message", "test"))
    runtime = name_fallback(methods.filter("not _test").select(F.col("message").alias("name"), "definition_id"), limit)
    tests = name_fallback(methods.select(F.col("message").alias("name"), "definition_id"), limit)
    is_test = F.coalesce("test", F.lit(False))
    by_name = named.filter(~is_test).join(runtime, F.col("message") == F.col("name")).unionByName(named.filter(is_test).join(tests, F.col("message") == F.col("name"))).select("site", "definition_id")
    by_name = cut(by_name)
    direct = rows.filter("strategy = 'physical'").join(nodes.select(F.col("definition_id").alias("physical_target"), F.lit(True).alias("_there")), "physical_target", "left").select("site", F.col("physical_target").alias("definition_id"), "_there")

    firsts = found.filter("place = 1").select("site", "definition_id").distinct().join(chained.select("site", "status"), "site")
    facts = firsts.join(rows.select("site", "caller_owner", F.col("receiver_name").alias("receiver_owner"), "receiver_kind", "original"), "site")
    facts = facts.join(nodes.select("definition_id", F.col("owner").alias("target_owner"), "visibility"), "definition_id")
    judged = cut(protected_outcome(facts, instance, classes))
    unsure = judged.filter("protected_ok is null and status = 'complete'").select("site").distinct().withColumn("_unsure", F.lit(True))
    judged = judged.join(unsure, "site", "left").withColumn("status", F.when(F.col("_unsure").isNotNull(), "partial").otherwise(F.col("status")))
    private = private_rejected(F.col("visibility"), F.col("receiver_kind"), F.col("original"), F.lit(None).cast("boolean"))
    why = F.when(F.col("status") == "complete", F.when(~F.col("protected_ok"), "protected_visibility").when(private, "private_visibility"))
    judged = judged.withColumn("_why", why)
    targets = union([judged.filter("_why is null").select("site", "definition_id"), by_name, direct.filter("_there").select("site", "definition_id")])
    final = chained.join(unsure, "site", "left").withColumn("status", F.when(F.col("_unsure").isNotNull(), "partial").otherwise(F.col("status")))
    filled = by_name.select("site").distinct().withColumn("_named", F.lit(True))
    fell = final.join(unknown, "site", "left_anti").select("site", "status", "reason")
    loose = named.select("site").distinct().join(filled, "site", "left").select("site", F.when(F.col("_named"), "partial").otherwise("unknown").alias("status"), F.lit("name_fallback").alias("reason"))
    exact = direct.select("site", F.when(F.col("_there"), "complete").otherwise("unknown").alias("status"), F.when(F.col("_there"), "physical_definition").otherwise("physical_target_missing").alias("reason"))
    lookups = union([fell, loose, exact])
    complete = lookups.filter("status = 'complete'").select("site")
    hit = found.filter("place = 1").select("site", "definition_id").distinct()
    shadowed = found.filter("place = 2 and not missing").select("site", "definition_id").distinct().join(hit, ["site", "definition_id"], "left_anti").join(complete, "site", "left_semi")
    rejected = judged.filter("_why is not null").select("site", "definition_id", F.col("_why").alias("reason")).unionByName(shadowed.withColumn("reason", F.lit("shadowed_by_lookup_order")))
    return told(lookups), told(targets.distinct()), told(rejected)
