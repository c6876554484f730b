"""Graph fixpoints as frontier loops: each round joins the new rows only, and cuts its lineage.

The driver sees counts; tables stay distributed. A node's predecessor is a minimum, so hubs are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import bucketed, cut

FEW = 200_000  # rows of a frontier (a domain and a node each) that are broadcast at most; a larger one is shuffled to the edges


def reach(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000, preds: bool = True) -> DataFrame:
    """(domain, node, hops, pred): nodes reachable from each domain's roots.

    ``edges`` (src, dst) or (domain, src, dst), which may repeat; ``roots`` (domain, node). hops is the length of a shortest path, pred
    the smallest predecessor on one (NULL for roots). Without ``preds`` there is no such column, and a round is a distinct by hash: the
    smallest of texts is found by sorting all that a round meets.
    """
    keys = ["domain", "src"] if "domain" in edges.columns else ["src"]
    with bucketed(edges.select(*keys, "dst"), *keys) as dealt:
        return along(dealt, keys, roots, max_rounds, preds)


def along(edges: DataFrame, keys: list[str], roots: DataFrame, max_rounds: int = 1000, preds: bool = True) -> DataFrame:
    """``reach`` over edges that are ``bucketed`` by ``keys`` already."""
    columns = ["domain", "node", "hops", *(["pred"] if preds else [])]
    start = roots.select("domain", "node").distinct().select("domain", "node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("pred"))
    known = cut(start.select(*columns))
    found, frontier, n = [known], known, known.count()
    for hop in range(1, max_rounds + 1):
        at = frontier.select("domain", F.col("node").alias("src"))
        met = edges.join(F.broadcast(at) if n <= FEW else at.hint("shuffle_hash"), keys).select("domain", F.col("dst").alias("node"), "src")
        step = met.groupBy("domain", "node").agg(F.min("src").alias("pred")) if preds else met.select("domain", "node").distinct()
        seen = found[0]
        for part in found[1:]:
            seen = seen.unionByName(part)
        frontier = cut(step.join(seen, ["domain", "node"], "left_anti").withColumn("hops", F.lit(hop)).select(*columns))
        n = frontier.count()
        if not n:
            return seen
        found.append(frontier)
        if len(found) > 8:
            found = [cut(seen.unionByName(frontier))]
    raise RuntimeError("reach did not settle")


def closure(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(ancestor, descendant, depth) of (parent, child) pairs; depth is the shortest. Each round joins the new rows only."""
    edges = cut(pairs.select(F.col("parent").alias("_mid"), F.col("child").alias("descendant")).filter("_mid is not null and descendant is not null").distinct())
    known = cut(edges.select(F.col("_mid").alias("ancestor"), "descendant", F.lit(1).alias("depth")))
    frontier = known
    for depth in range(2, max_rounds + 2):
        step = frontier.select("ancestor", F.col("descendant").alias("_mid")).join(edges, "_mid").select("ancestor", "descendant").distinct()
        frontier = cut(step.join(known, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier))
    raise RuntimeError("closure did not settle")


def taint(edges: DataFrame, alive: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that reach a seed along edges whose targets are not alive: reach over reversed, filtered edges."""
    open_ = edges.join(alive.select(F.col("node").alias("dst")), "dst", "left_anti")
    back = open_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds.select(F.lit("taint").alias("domain"), "node")).select("node", "hops")


def nearest(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, hops): undirected distance to the nearest target."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, targets.select(F.lit("near").alias("domain"), "node")).select("node", "hops")


def witness_paths(reached: DataFrame, targets: DataFrame, max_hops: int = 200) -> DataFrame:
    """(node, path): root-to-node paths along the stored predecessors, for bounded targets; raises if one is longer than ``max_hops``."""
    now = targets.select("node", F.col("node").alias("at"), F.array("node").alias("path"))
    done = []
    for _ in range(max_hops):
        step = cut(now.join(reached.select(F.col("node").alias("at"), "pred"), "at").select("node", "path", "pred"))
        done.append(step.filter("pred is null").select("node", "path"))
        now = step.filter("pred is not null").select("node", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError("witness_paths did not settle")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
