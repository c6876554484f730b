"""Reachability after a change of the graph, from the reachability before it: delete, derive again, extend.

Every reached node has a predecessor, so reached nodes are trees below the roots. A removed edge that is in no tree changes
nothing. Else what hangs below it is taken out, and what still has an edge from a node that stayed is put back, with all that
follows from it; added edges extend the rest. Rounds move the changed nodes only; the tables of all nodes and edges are
scanned beside them and, while the changed ones are few enough to be broadcast, not shuffled. Edges are shuffled once, into a bucketed table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import fixpoint
from factloom.operators.common import bucketed, cut

FEW = 200_000  # changed rows (a domain and a node each) that are broadcast at most


def _few(df: DataFrame) -> DataFrame:
    """A cut table, with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with(parts: list[DataFrame], more: DataFrame) -> list[DataFrame]:
    """Disjoint cut tables and one more; they are written anew only when there are many."""
    parts = [*parts, more]
    return [cut(_all(parts))] if len(parts) > 8 else parts


def update_reach(before: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(after, changed): after (domain, node, pred) is what ``roots`` reach along ``edges``; changed (domain, node, change: lost or gained).

    ``before`` (domain, node, pred): a reachability with predecessors on ``edges`` without ``added`` and with ``removed`` (src, dst)
    and other roots. ``roots`` (domain, node). Predecessors of ``after`` lead to a root, not always by a shortest path.
    """
    with bucketed(edges.select("src", "dst"), "src") as dealt:
        return _update(before, dealt, removed, added, roots, max_rounds)


def reach_changes(links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, node, change): what two graphs reach otherwise, from the one table ``links`` (src, dst, before, after: whether a graph has it).

    ``before`` and ``after`` (domain, node) are their roots. Links may repeat; both graphs are read from one table, dealt once.
    """
    sides = [F.max(c).alias(c) for c in ("before", "after")]
    once = lambda rows: rows.groupBy("src", "dst").agg(*sides).filter("before or after")
    with bucketed(links.select("src", "dst", "before", "after"), "src", then=once) as dealt:
        of = lambda condition: dealt.filter(condition).select("src", "dst")
        reached = fixpoint.along(of("before"), ["src"], before)
        return _update(reached, of("after"), of("before and not after"), of("after and not before"), after, 1000)[1]


def _update(before: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, roots: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """``update_reach`` over edges that are bucketed by src."""
    keys = ["domain", "node"]
    roots = cut(roots.select(*keys).distinct())
    tree = before.select(*keys, "pred")
    gone = _few(cut(removed.select(F.col("src").alias("pred"), F.col("dst").alias("node")).distinct()))
    unrooted = tree.filter("pred is null").join(roots, keys, "left_anti").select(*keys)
    frontier = cut(tree.join(gone, ["pred", "node"]).select(*keys).unionByName(unrooted).distinct())
    parts = [frontier]
    for _ in range(max_rounds):
        if frontier.isEmpty():
            break
        below = tree.join(_few(frontier.withColumnRenamed("node", "pred")), ["domain", "pred"]).select(*keys)
        frontier = cut(below.distinct().join(_all(parts), keys, "left_anti"))
        parts = _with(parts, frontier)
    else:
        raise RuntimeError("update_reach did not settle")
    lost = _all(parts)

    stayed = tree.join(_few(lost), keys, "left_anti")

    def here(found: DataFrame) -> DataFrame:
        """Rows (domain, node) that stayed, of a small table."""
        return stayed.join(_few(found), keys, "left_semi").select(*keys)

    few = lost.count() <= FEW
    fresh = added.select("src", "dst")
    if few:
        fresh = fresh.unionByName(edges.join(F.broadcast(lost.select(F.col("node").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
    fresh = cut(fresh.distinct())
    starts = cut(fresh.select(F.col("src").alias("node")).distinct())
    sources = stayed.select(*keys).join(_few(starts), "node", "left_semi")
    aims = sources.withColumnRenamed("node", "src").join(fresh, "src").groupBy("domain", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
    if not few:  # the edges of what stayed, which are fewer than all edges, and none of them is shuffled
        at = stayed.select("domain", F.col("node").alias("src")).hint("shuffle_hash")
        near = edges.join(at, "src").groupBy("domain", F.col("dst").alias("node")).agg(F.min("src").alias("pred")).join(lost, keys, "left_semi")
        aims = aims.unionByName(near).groupBy(*keys).agg(F.min("pred").alias("pred"))
    new_roots = roots.join(tree.select(*keys), keys, "left_anti").unionByName(roots.join(_few(lost), keys, "left_semi"))
    aims = cut(aims.join(new_roots, keys, "left_anti").unionByName(new_roots.withColumn("pred", F.lit(None).cast(tree.schema["pred"].dataType))))
    frontier = cut(aims.join(here(aims.select(*keys)), keys, "left_anti"))
    parts = [frontier]
    for _ in range(max_rounds):
        n = frontier.count()
        if not n:
            break
        at = frontier.select("domain", F.col("node").alias("src"))
        step = edges.join(F.broadcast(at) if n <= FEW else at.hint("shuffle_hash"), "src").groupBy("domain", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        step = cut(step.join(_all(parts).select(*keys), keys, "left_anti"))
        frontier = cut(step.join(here(step.select(*keys)), keys, "left_anti"))
        parts = _with(parts, frontier)
    else:
        raise RuntimeError("update_reach did not settle")
    found = _all(parts)
    was = cut(tree.join(_few(found.select(*keys)), keys, "left_semi").select(*keys))
    changed = lost.join(found.select(*keys), keys, "left_anti").withColumn("change", F.lit("lost")).unionByName(found.select(*keys).join(was, keys, "left_anti").withColumn("change", F.lit("gained")))
    return stayed.unionByName(found.select(*keys, "pred")), changed


def edge_delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges after, removed, added) of two edge tables (src, dst), in one pass over both."""
    sides = before.select("src", "dst", F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select("src", "dst", F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    told = sides.groupBy("src", "dst").agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    delta = cut(told.filter("_a <> _b"))
    return after.select("src", "dst"), delta.filter("_b = 1").select("src", "dst"), delta.filter("_a = 1").select("src", "dst")
