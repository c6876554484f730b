"""Method lookup chains of classes: orders of a depth-first walk as smallest paths.

A walk visits an owner's prepends (last first), the owner, its includes (last first) and its superclass, every name once,
where it is met first. A place is a path of (group, index) steps from the start; paths compare like the walk's order, a
prefix before its extensions. Keeping each name's smallest path is enough, because a name that is met again only leads to
names met before.

Every path is a number of superclass steps, then nothing or a listed name and what lies behind it, and fewer superclass steps
come first. So superclass lines, which may be long, are made by path doubling, in rounds that grow with the logarithm
of the depth; what a class lists is walked from the listed names only, and the two meet in one join. That holds where no
listed name leads back to the class that lists it; owners that can reach such a circle are walked step by step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.common import cut

PATH = "array<struct<g:int,i:int>>"
PREPENDS, SELF, INCLUDES, SUPER = 0, 1, 2, 3


def _listed(classes: DataFrame, column: str, group: int) -> DataFrame:
    """(parent, child, g, i): names of a list column, the last one first."""
    places = classes.select(F.col("id").alias("parent"), F.posexplode(column).alias("_p", "child"))
    return places.filter("child is not null").select("parent", "child", F.lit(group).alias("g"), (-F.col("_p")).alias("i"))


def _above(classes: DataFrame) -> DataFrame:
    return classes.filter("superclass is not null").select(F.col("id").alias("parent"), F.col("superclass").alias("child"), F.lit(SUPER).alias("g"), F.lit(0).alias("i"))


def walk(steps: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(owner, candidate, path): the smallest path to every name that each start (owner) reaches, itself included."""
    known = cut(starts.select("owner", F.col("owner").alias("candidate"), F.array().cast(PATH).alias("path")).distinct())
    frontier = known
    for _ in range(max_rounds):
        step = frontier.join(steps, F.col("candidate") == F.col("parent"))
        step = step.select("owner", F.col("child").alias("candidate"), F.concat("path", F.array(F.struct("g", "i"))).cast(PATH).alias("path"))
        step = step.groupBy("owner", "candidate").agg(F.min("path").alias("path"))
        before = known.select("owner", "candidate", F.col("path").alias("_old"))
        frontier = cut(step.join(before, ["owner", "candidate"], "left").filter(F.col("_old").isNull() | (F.col("path") < F.col("_old"))).drop("_old"))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier).groupBy("owner", "candidate").agg(F.min("path").alias("path")))
    raise RuntimeError("walk did not settle")


def superclass_lines(classes: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(owner, k, klass): every class that is k > 0 superclass steps above an owner, by the fewest steps; an owner above itself in a cycle.

    With all pairs up to a distance, a pair of just that distance is a jump: jumps join pairs, so each round doubles the
    distance, twice, and makes each pair once. A line that repeats has no jump left and nothing new to find.
    A class has one superclass: of several rows the smallest counts.
    """

    def longer(pairs: DataFrame, reach: int) -> DataFrame:
        jump = pairs.filter(F.col("k") == reach).select(F.col("owner").alias("_from"), F.col("klass").alias("owner"))
        more = jump.join(pairs, "owner").select(F.col("_from").alias("owner"), (F.col("k") + reach).alias("k"), "klass")
        return pairs.unionByName(more.join(pairs.select("owner", "klass"), ["owner", "klass"], "left_anti").select("owner", "k", "klass"))

    first = classes.filter("superclass is not null").groupBy(F.col("id").alias("owner")).agg(F.min("superclass").alias("klass"))
    pairs, reach = cut(first.select("owner", F.lit(1).alias("k"), "klass")), 1
    for _ in range(max_rounds):
        pairs = cut(longer(longer(pairs, reach), 2 * reach))
        if pairs.filter(F.col("k") > reach).isEmpty():
            return pairs
        reach *= 4
    raise RuntimeError("superclass lines did not settle")


def _lines(classes: DataFrame, owners: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(owner, k, klass) of owners, themselves at 0 steps."""
    above = superclass_lines(classes) if above is None else above
    above = above.filter("klass <> owner").join(owners, "owner", "left_semi")
    return owners.select("owner", F.lit(0).alias("k"), F.col("owner").alias("klass")).unionByName(above)


def method_chains(classes: DataFrame, owners: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """(owner, pos, candidate): the instance lookup chain of every owner, from position 0.

    ``classes`` (id, superclass, includes, prepends); a name without a class row is a chain of its own. Cycles end where a name
    was met before. ``owners`` (owner): the starts, all class ids by default. ``above``: the ``superclass_lines``, if they are there.
    """
    starts = (classes.select(F.col("id").alias("owner")) if owners is None else owners.select("owner")).filter("owner is not null").distinct()
    listed = cut(_listed(classes, "prepends", PREPENDS).unionByName(_listed(classes, "includes", INCLUDES)))
    lines = _lines(classes, starts, above)
    own = lines.select("klass").distinct().select("klass", F.col("klass").alias("candidate"), F.array().cast(PATH).alias("path"))
    circles = None
    if not listed.isEmpty():
        behind = walk(listed.unionByName(_above(classes)), listed.select(F.col("child").alias("owner")).distinct())
        inside = listed.join(behind, F.col("child") == F.col("owner"))
        step = F.concat(F.array(F.struct("g", "i")), "path").cast(PATH)
        own = own.unionByName(inside.select(F.col("parent").alias("klass"), "candidate", step.alias("path")))
        circles = cut(inside.filter(F.col("candidate") == F.col("parent")).select("candidate").distinct())
    best = lines.join(own, "klass").groupBy("owner", "candidate").agg(F.min(F.struct("k", "path")).alias("_at"))
    best = best.select("owner", "candidate", "_at.k", "_at.path")
    if circles is not None and not circles.isEmpty():
        best = cut(best)
        turning = cut(best.join(circles, "candidate", "left_semi").select("owner").distinct())
        slow = walk(listed.unionByName(_above(classes)), turning).select("owner", "candidate", F.lit(0).alias("k"), "path")
        best = best.join(turning, "owner", "left_anti").unionByName(slow)
    emitted = F.concat("path", F.array(F.struct(F.lit(SELF).alias("g"), F.lit(0).alias("i"))))
    place = Window.partitionBy("owner").orderBy("k", emitted)
    return best.select("owner", (F.row_number().over(place) - 1).alias("pos"), "candidate")


def ancestors(classes: DataFrame) -> DataFrame:
    """(owner, pos, candidate): superclasses from position 1 on, until a name repeats; an owner is its own only in a cycle."""
    return superclass_lines(classes).select("owner", F.col("k").alias("pos"), F.col("klass").alias("candidate"))


def singleton_chains(classes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(owner, pos, candidate, sep): lookup entries of a class's own methods (``.``) and of what it extends (``#``).

    For the class and each superclass in turn: the chains of its singleton prepends (last first), its own methods, the chains of
    its singleton includes. A superclass without a class row ends the walk with its own methods.
    """
    above = superclass_lines(classes) if above is None else above
    lines = _lines(classes, classes.select(F.col("id").alias("owner")).distinct(), above)
    lists = _listed(classes, "singleton_prepends", PREPENDS).unionByName(_listed(classes, "singleton_includes", INCLUDES))
    chains = method_chains(classes, lists.select(F.col("child").alias("owner")).distinct(), above)
    extended = lists.join(chains, F.col("child") == F.col("owner")).select(F.col("parent").alias("klass"), "g", "i", "pos", "candidate", F.lit("#").alias("sep"))
    own = lines.select("klass").distinct().select("klass", F.lit(SELF).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("pos"), F.col("klass").alias("candidate"), F.lit(".").alias("sep"))
    place = Window.partitionBy("owner").orderBy("k", "g", "i", "pos")
    entries = lines.join(own.unionByName(extended), "klass").withColumn("_pos", F.row_number().over(place) - 1)
    return entries.select("owner", F.col("_pos").alias("pos"), "candidate", "sep")


def descendants(classes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(owner, candidate): every class and the classes below it, itself included; only classes with a row."""
    ids = classes.select(F.col("id").alias("owner")).distinct()
    return _lines(classes, ids, above).select(F.col("klass").alias("owner"), F.col("owner").alias("candidate")).join(ids, "owner", "left_semi")


def reachable_owners(classes: DataFrame) -> DataFrame:
    """(ancestor, owner): owners in the lookup chain of some class at or below the ancestor."""
    above = superclass_lines(classes)
    chains = method_chains(classes, above=above)
    below = descendants(classes, above).select(F.col("owner").alias("ancestor"), F.col("candidate").alias("_below"))
    return below.join(chains, F.col("_below") == F.col("owner")).select("ancestor", F.col("candidate").alias("owner")).distinct()
