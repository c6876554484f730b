"""Exact top-k inner products by the threshold algorithm.

Every query first gets a floor: its kth best score among at most ``SEEDS`` candidates. It is carried to all blocks of
candidates, and no score below it can be among the best k. A block keeps one sorted list for each dimension. Read to some
depth from the end that the signs of a query's components prefer, the lists bound what an unmet vector can score: the sum
of the components times the values at that depth. A query stops at the first depth (they double) whose bound is below its
floor (equal is not enough: a tie goes to the smaller id), and only the vectors met until then are scored. The bounds
need the lists' values alone, so the depth is known before anything is scored: where a query would meet a large part of the
block, the block is one plain matrix product instead. The blocks' best rows are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut

K = 20
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
SEEDS = 4096
DEPTHS = 256  # the first depth is a block's rows divided by this
DENSE = 0.2  # share of a block from which the plain product is cheaper than single rows


def _kinds(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the smallest kind whose sums of products are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return queries.astype(kind), vectors.astype(kind)


def stop_depths(queries: np.ndarray, sorted_values: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Depth at which each query may stop: the block's size where no bound falls below the floor (NaN: none known)."""
    n = len(sorted_values)
    up, down = np.where(queries > 0, queries, 0).astype(np.float64), np.where(queries < 0, queries, 0).astype(np.float64)
    stop = np.full(len(queries), n)
    depth = 0 if n else n
    while depth < n:
        bound = up @ sorted_values[depth].astype(np.float64) + down @ sorted_values[n - 1 - depth].astype(np.float64)
        stop = np.where((bound < floors) & (stop == n), depth, stop)
        depth = depth * 2 if depth else max(1, -(-n // DEPTHS))
    return stop


def threshold_search(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of each query's best k in one block at or above its floor, and the number of products.

    ``ids`` ascend; ``own`` has each query's id, which is not its candidate; a NaN floor lets all scores pass.
    """
    n = len(vectors)
    order = np.argsort(-vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, order, 0)
    stop = stop_depths(queries, values, floors)
    q, v = _kinds(queries, vectors)
    least = np.where(np.isnan(floors), -np.inf, floors)
    dense = stop * np.count_nonzero(queries, axis=1) >= DENSE * n
    dense |= stop == n
    found, products = [], 0
    step = max(1, (1 << 22) // max(n, 1))
    full = np.flatnonzero(dense)
    for a in range(0, len(full), step):
        part = full[a : a + step]
        s = q[part] @ v.T
        products += s.size
        r, c = np.nonzero((s >= least[part, None]) & (ids[None, :] != own[part, None]))
        found.append(_best(part[r], c, s[r, c], k))
    for i in np.flatnonzero(~dense & (stop > 0)):
        met = [order[: stop[i], d] if queries[i, d] > 0 else order[n - stop[i] :, d] for d in np.flatnonzero(queries[i])]
        c = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        s = v[c] @ q[i]
        products += len(c)
        keep = (s >= least[i]) & (ids[c] != own[i])
        found.append(_best(np.full(keep.sum(), i), c[keep], s[keep], k))
    rows, cols, scores = (np.concatenate([f[j] for f in found] + [np.zeros(0, np.int64)]).astype(np.int64) for j in range(3))
    return rows, ids[cols], scores, products


def _best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller column."""
    by = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[by], cols[by], scores[by]
    first = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], scores[keep]


def matrix(x: pd.Series, dims: int) -> np.ndarray:
    """Rows of a list column as one integer matrix, shorter ones padded with zeros."""
    out = np.zeros((len(x), dims), np.int64)
    for i, row in enumerate(x):
        out[i, : len(row)] = row
    return out


def top_k(
    vectors: DataFrame, query_rule, k: int = K, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seeds: int = SEEDS,
) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k best other rows, by quantised inner product.

    ``query_rule`` is a condition on the id column. Components become floor(scale * x). Rows with a null id, a null vector
    or a null, infinite or NaN component take no part; of rows that repeat an id the smallest vector stays; shorter vectors
    count as padded with zeros; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
    gives an empty result; other columns are not read. The seeds only speed up the search: every row is a candidate.
    """
    floored = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), floored.alias("x"), F.col(vector_col).alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & finite).groupBy("vec_id").agg(F.min("x").alias("x"))
    clean = cut(clean)
    is_query = query_rule(F.col("vec_id"))
    n, nq, dims = clean.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    cb, qb = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))

    # At most about ``seeds`` candidates, spread by hash, go to every block of queries.
    seed = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, -(-n // seeds)))) == 0
    of_query = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(qb)).cast("long")
    floor_queries = clean.filter(is_query).select("vec_id", "x", F.lit(True).alias("q"), of_query.alias("qb"))
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long")))
    floor_seeds = clean.filter(seed).select("vec_id", "x", F.lit(False).alias("q"), to_all.alias("qb"))

    def floors(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["q"].to_numpy(bool)
        ids, x = pdf["vec_id"].to_numpy(), matrix(pdf["x"], dims)
        q, v = _kinds(x[is_q], x[~is_q])
        out = np.full(len(q), np.nan)
        for a in range(0, len(q), 512):
            s = (q[a : a + 512] @ v.T).astype(np.float64)
            s[ids[is_q][a : a + 512, None] == ids[~is_q][None, :]] = -np.inf
            if s.shape[1] > k:
                out[a : a + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return pd.DataFrame({"vec_id": ids[is_q], "x": list(x[is_q]), "floor": np.where(np.isfinite(out), out, np.nan)})

    floored_queries = floor_queries.unionByName(floor_seeds).groupBy("qb").applyInPandas(floors, "vec_id long, x array<long>, floor double")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long")))
    queries = floored_queries.select("vec_id", "x", "floor", F.lit(True).alias("q"), blocks.alias("cb"), of_query.alias("qb"))
    of_block = F.pmod(F.xxhash64("vec_id"), F.lit(cb)).cast("long")
    candidates = clean.select("vec_id", "x", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("q"), of_block.alias("cb"), to_all.alias("qb"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        q, ids, x = pdf["q"].to_numpy(bool), pdf["vec_id"].to_numpy(), matrix(pdf["x"], dims)
        floor = pdf["floor"].to_numpy(float)[q]
        rows, found, score, _ = threshold_search(x[q], ids[q], floor, x[~q], ids[~q], k)
        return pd.DataFrame({"query_id": ids[q][rows], "vec_id": found, "score": score})

    found = candidates.unionByName(queries).groupBy("cb", "qb").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
