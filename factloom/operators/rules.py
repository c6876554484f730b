"""Rules about definitions that a framework or the language calls: implicit callers, conventions, routes, load references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import glob_regex, underscore

#: Fixed names that the language itself calls.
HOOKS = ("inherited", "included", "extended", "prepended", "method_added", "singleton_method_added", "const_missing", "method_missing", "respond_to_missing?")
PROTOCOLS = ("==", "eql?", "hash", "<=>", "to_s", "to_str", "to_a", "to_h", "to_proc", "inspect", "coerce", "succ", "initialize_copy", "marshal_dump", "marshal_load")


def implicit_callers(nodes: DataFrame, rules: list[tuple[str, list[str], str]], reachable: DataFrame) -> DataFrame:
    """(definition_id, reason) of nodes (definition_id, name, owner) that are called implicitly: hook, protocol, or the first rule.

    A rule is (pattern of the name, ancestors, reason); without ancestors it holds for every owner, else the owner must be
    reachable from one of them: ``reachable`` (ancestor, owner) as ``chains.reachable_owners`` gives it. The rules are part
    of the plan, the ancestors meet the owners once.
    """
    asked = sorted({a for _, up, _ in rules for a in up})
    above = reachable.filter(F.col("ancestor").isin(*asked)).groupBy("owner").agg(F.collect_set("ancestor").alias("_up"))
    told = nodes.select("definition_id", "name", "owner").join(above, "owner", "left")
    reason = F.when(F.col("name").isin(*HOOKS), "hook").when(F.col("name").isin(*PROTOCOLS), "protocol")
    for pattern, up, why in rules:
        fits = F.coalesce(F.arrays_overlap("_up", F.array(*[F.lit(a) for a in up])), F.lit(False)) if up else F.lit(True)
        reason = reason.when(F.col("name").rlike(pattern) & fits, why)
    return told.select("definition_id", reason.alias("reason")).filter("reason is not null")


def convention_hits(nodes: DataFrame, rules: list[dict], ancestors: DataFrame, frameworks: list[str]) -> DataFrame:
    """(definition_id, rule_id): the first rule that holds for a node (definition_id, name, owner).

    A rule has id, and lists methods, owners (globs), ancestors (names, or what they enclose) and frameworks; empty methods or
    frameworks take all, and an owner or an ancestor must fit. ``ancestors`` (owner, candidate).
    """
    if len({r["id"] for r in rules}) != len(rules):
        raise ValueError("rules must have ids of their own")
    up = ancestors.groupBy("owner").agg(F.collect_set("candidate").alias("_up"))
    told = nodes.select("definition_id", "name", "owner").join(up, "owner", "left")
    hit: Column = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        if r.get("frameworks") and not set(r["frameworks"]) & set(frameworks):
            continue
        named = F.col("name").isin(*r["methods"]) if r.get("methods") else F.lit(True)
        owned = F.col("owner").rlike("|".join(glob_regex(g) for g in r["owners"])) if r.get("owners") else F.lit(False)
        below = F.lit(False)
        for a in r.get("ancestors", []):
            below = below | F.array_contains("_up", a) | F.array_join("_up", "\n").rlike(f"(?m)^\\Q{a}::\\E")
        hit = hit.when(named & (F.coalesce(owned, F.lit(False)) | F.coalesce(below, F.lit(False))), r["id"])
    return told.select("definition_id", hit.alias("rule_id")).filter("rule_id is not null")


def route_targets(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol_id, definition_id): public methods that routes (symbol_id, as Owner#action) lead to.

    A symbol that is defined leads to its public definitions only; else public methods of the action's name whose owner ends
    with the controller and whose file is the controller's own. ``nodes`` (definition_id, symbol_id, owner, name, file, visibility).
    """
    asked = routes.select("symbol_id").distinct()
    public = nodes.filter("visibility = 'public'")
    exact = asked.join(public.select("symbol_id", "definition_id"), "symbol_id")
    rest = asked.join(nodes.select("symbol_id").distinct(), "symbol_id", "left_anti").filter(F.contains("symbol_id", F.lit("Controller#")))
    controller, action = F.substring_index("symbol_id", "#", 1), F.regexp_extract("symbol_id", "^[^#]*#(.*)$", 1)
    file = F.concat(F.lit("app/controllers/"), F.replace(underscore(F.regexp_replace(controller, "Controller$", "")), F.lit("::"), F.lit("/")), F.lit("_controller.rb"))
    rest = rest.select("symbol_id", controller.alias("_c"), action.alias("name"), file.alias("file"))
    near = rest.join(public.select("definition_id", "owner", "name", "file"), ["name", "file"]).filter(F.endswith("owner", "_c"))
    return exact.unionByName(near.select("symbol_id", "definition_id")).distinct()


def clean_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` parts; NULL if it is absolute or leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    done = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.when(~path.startswith("/") & (F.coalesce(F.get(done, F.lit(0)), F.lit("")) != ".."), F.when(F.size(done) == 0, ".").otherwise(F.array_join(done, "/")))


#: Nodes that stand for all file roots outside tests, and for all of them.
HUB, TEST_HUB = "load:runtime", "load:test"


@dataclass
class LoadGraph:
    """edges (site, caller_id, target, strategy) from callers to roots or hubs, hubs (src, dst) from hubs to roots, unresolved (site),
    and blockers of the callers of unknown paths."""

    edges: DataFrame
    hubs: DataFrame
    unresolved: DataFrame
    blockers: DataFrame

    def graph(self) -> DataFrame:
        """(src, dst): what a reachability walks; hubs are nodes of it."""
        return self.edges.select(F.col("caller_id").alias("src"), F.col("target").alias("dst")).distinct().unionByName(self.hubs)


def load_edges(references: DataFrame, roots: DataFrame) -> LoadGraph:
    """Load references (site, caller_id, file, test, kind, path, literal) to file roots (file, definition_id, test).

    A literal require_relative is read from its file's folder, another literal from ``lib`` or as it is below ``lib``; a path
    without extension also stands for the source file. Literals without a root are unresolved. A reference with an unknown path
    may lead to any root, tests' only if it is in a test itself: it has one edge to a hub, and the hub one to each root, so the
    pairs of callers and roots are never formed. Its caller is blocked.
    """
    literal = references.filter("literal")
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    near = clean_path(F.concat(folder, F.col("path")))
    bare = lambda p: F.when(~F.element_at(F.split(p, "/"), -1).rlike(r"[^.].*\.[^.]*$"), F.array(p, F.concat(p, F.lit(".rb")))).otherwise(F.array(p))
    plain = clean_path(F.col("path"))
    none = F.array().cast("array<string>")
    wide = F.array_distinct(F.concat(F.when(plain.startswith("lib/"), bare(plain)).otherwise(none), bare(F.concat(F.lit("lib/"), plain))))
    relative = F.col("kind") == "require_relative"
    places = F.when(relative, F.when(near.isNotNull(), bare(near)).otherwise(none)).otherwise(F.coalesce(F.when(plain.isNotNull(), wide), none))
    strategy = F.when(relative, "require_relative").when(F.col("kind") == "autoload", "autoload_lib_path").otherwise("require_lib_path")
    aims = literal.select("site", "caller_id", strategy.alias("strategy"), F.explode(places).alias("file"))
    found = aims.join(roots.select("file", "definition_id"), "file").select("site", "caller_id", F.col("definition_id").alias("target"), "strategy")
    unresolved = literal.select("site").join(found.select("site").distinct(), "site", "left_anti")
    open_ = references.filter("not literal")
    test = F.coalesce("test", F.lit(False))
    unknown = open_.select("site", "caller_id", F.when(test, TEST_HUB).otherwise(HUB).alias("target"), F.lit("dynamic_conservative").alias("strategy"))
    hubs = roots.select(F.when(test, TEST_HUB).otherwise(HUB).alias("src"), F.col("definition_id").alias("dst")).distinct()
    both = references.sparkSession.createDataFrame([(TEST_HUB, HUB)], "src string, dst string")
    reason = F.concat(F.min("kind"), F.lit(" path is not a static string or symbol"))
    per = open_.groupBy("caller_id").agg(F.count(F.lit(1)).alias("n_sites"), reason.alias("reason"))
    told = per.select(F.concat(F.lit("load:"), "caller_id").alias("blocker_id"), F.lit("dynamic_load").alias("kind"), F.lit("definition").alias("scope_kind"), F.col("caller_id").alias("scope_value"), F.lit("exact").alias("scope_match"), "reason", "n_sites")
    return LoadGraph(found.unionByName(unknown), hubs.unionByName(both), unresolved, told)
