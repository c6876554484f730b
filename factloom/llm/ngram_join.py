"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Texts become sets of 5-word shingles; documents with one set are one class, and only classes are compared. A class has a
MinHash signature for each of ``TREES`` trees. A tree is the prefix trie of these signatures, kept as sorted rows: each sub-trie
below the shortest prefix that can be needed is one run of a sorted partition, and comparing neighbours of the run gives each class the
longest prefix that it shares with any other class there.

Prefixes are then shortened for each class on its own. At a cap of x values it asks every tree for the classes that share its
min(x, longest shared prefix) values, and a partner at the threshold escapes all trees with the probability of ``missed``. The
class takes the largest cap at which that is at most 1 - ``recall``, so one that meets others in few trees only asks for long
prefixes, and one that meets them in many shortens down to ``depth_for``, where the recall holds whatever the data are. (A partner that would lengthen
the longest shared prefix is itself met there, so the bound holds although the lengths come from the data.)

Classes below one asked prefix are linked to the smallest of them, and the components of these links are the candidate families. Inside a
family all pairs are verified exactly, by counting common shingles with matrix products. Large families are cut into blocks, each
pair of blocks is one task, and only per-class sums and spanning links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, cut, packed, parts, small
from factloom.llm.components import components

SHINGLE = 5
THRESHOLD = "0.8"
TREES = 32
MAX_DEPTH = 8  # values of the shortest prefix at most
LONGER = 3  # values by which a prefix may be longer
RECALL = 0.99999
BLOCK_WEIGHT = 1_500_000  # shingles in one block of a family, a document counting as 300 at least
_RNG = np.random.default_rng(99)
_MULT = _RNG.integers(1, 2**32, TREES * (MAX_DEPTH + LONGER), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 2**32, TREES * (MAX_DEPTH + LONGER), dtype=np.uint64).astype(np.uint32)


def depth_for(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The deepest prefix that still reaches the recall at the threshold, whatever the data: no class shortens below it."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def missed(threshold: float, lengths: list[int]) -> float:
    """The chance that a pair at the threshold shares none of the prefixes of these lengths, one of each tree."""
    return math.prod(1 - threshold**n for n in lengths)


def cap_for(shared: list[Column], threshold: float, trees: int, depth: int, recall: float) -> Column:
    """The largest cap on a class's prefixes that reaches the recall.

    ``shared`` counts the class's trees by the length of the longest prefix shared there: ``depth``, one more, and so on.
    Trees without a shared prefix of ``depth`` values have nobody at it, so they count as asked at ``depth``.
    """
    fails = [math.log1p(-(threshold ** (depth + i))) for i in range(len(shared))]
    none = F.lit(trees) - sum(shared[1:], shared[0])
    cap = F.lit(depth)
    for top in range(1, len(shared)):
        chance = none * F.lit(fails[0])
        for i, n in enumerate(shared):
            chance = chance + n * F.lit(fails[min(i, top)])
        cap = F.when(chance <= math.log(1 - recall), depth + top).otherwise(cap)
    return cap


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of every row, with bounds. A text of fewer than k words is one shingle."""
    h, bounds = arrays.words(data, offsets)
    n = np.diff(bounds)
    g = arrays.grams(h, k)
    row = np.repeat(np.arange(len(n)), n)
    ok = row[: len(g)] == row[k - 1 : k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    values, rows = g[ok], row[: len(g)][ok]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.array([arrays.mix(arrays.grams(h[bounds[r] : bounds[r + 1]], int(n[r])) + np.uint64(n[r]))[0] for r in few], np.uint64)
        values, rows = np.concatenate([values, short]), np.concatenate([rows, few])
    sets, start = [], np.searchsorted(rows, np.arange(len(n) + 1)) if not len(few) else None
    if start is None:
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
        start = np.searchsorted(rows, np.arange(len(n) + 1))
    for r in range(len(n)):
        sets.append(np.unique(values[start[r] : start[r + 1]]))
    out = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return out, np.cumsum([0, *map(len, sets)])


def signature_keys(values: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(rows, trees, 2) of rows that have shingles: a tree's prefix of ``depth`` values as a hash, and the LONGER next
    values, 16 bits of each, in order in one number. (Values told apart by 16 bits may only add candidates.)"""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    keys = np.zeros((len(bounds) - 1, trees, 2), np.uint64)
    for t in range(trees):
        for d in range(depth + LONGER):
            i = t * (MAX_DEPTH + LONGER) + d
            x = (low ^ _XOR[i]) * _MULT[i]
            x ^= x >> np.uint32(15)
            x *= _MULT[-1 - i]
            least = np.minimum.reduceat(x, bounds[:-1]).astype(np.uint64)
            if d < depth:
                keys[:, t, 0] = keys[:, t, 0] * arrays.BASE + least
            else:
                keys[:, t, 1] = (keys[:, t, 1] << np.uint64(16)) | (arrays.mix(least + np.uint64(1)) & np.uint64(0xFFFF))
        keys[:, t, 0] = arrays.mix(keys[:, t, 0] ^ np.uint64((t + 1) << 40))
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """(id, th, c, n, keys): id, text hash, class (16 bytes), shingle count and signatures of texts that have words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("_text"))
            for i, j in arrays.chunks(offsets):
                values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = np.flatnonzero(np.diff(bounds))
                if not len(rows):
                    continue
                at = np.append(bounds[:-1][rows], bounds[-1])
                keys = signature_keys(values, at, trees, depth)
                one, two = np.add.reduceat(arrays.mix(values), at[:-1]), np.add.reduceat(arrays.mix(values * arrays.BASE), at[:-1])
                pair = np.stack([one, two], 1)
                take = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("th").take(take), pa.array([p.tobytes() for p in pair], pa.binary()), pa.array(np.diff(at)), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["id", "th", "c", "n", "keys"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"id {kind}, th long, c binary, n long, keys binary")


def shared_lengths(tails: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """How many of the LONGER values each two neighbours of a sorted run share; -1 where they are of different sub-tries."""
    out = np.where(nodes[1:] == nodes[:-1], 0, -1)
    for i in range(1, LONGER + 1):
        out += (out == i - 1) & (tails[1:] >> np.uint64(16 * (LONGER - i)) == tails[:-1] >> np.uint64(16 * (LONGER - i)))
    return out


def tries(classes: DataFrame, trees: int) -> DataFrame:
    """(c, node, tail, longer) for each class and tree where another class shares the prefix ``node``.

    longer: by how many values the longest prefix shared there is longer. Rows are dealt by node and sorted inside a
    partition, so a sub-trie is one run; a task keeps one batch and the row before it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64).reshape(-1, 2)
            c = b.column("c").take(pa.array(np.repeat(np.arange(b.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([c, pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["c", "node", "tail"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, -1  # the last row read, not yet given out, and what it shares with the row before it
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            share = shared_lengths(now.column("tail").to_numpy().view(np.uint64), now.column("node").to_numpy())
            best = np.maximum(np.concatenate([[before], share[:-1]]), share) if len(share) else np.zeros(0, np.int64)
            yield told(now.slice(0, len(best)), best)
            held, before = now.slice(now.num_rows - 1), share[-1] if len(share) else before
        if held is not None:
            yield told(held, np.array([before]))

    def told(b: pa.RecordBatch, best: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.flatnonzero(best >= 0))
        return pa.RecordBatch.from_arrays([*[b.column(x).take(at) for x in ("c", "node", "tail")], pa.array(best[best >= 0].astype(np.int32))], ["c", "node", "tail", "longer"])

    under = classes.select("c", "keys").mapInArrow(rows, "c binary, node long, tail long")
    return under.repartition(F.col("node")).sortWithinPartitions("node", "tail").mapInArrow(runs, "c binary, node long, tail long, longer int")


def trie_links(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(u, v): each class and the smallest class below a prefix that it, or another class below it, asks for."""
    met = tries(classes, trees)
    mine = Window.partitionBy("c")  # a class has a row a tree at most
    shared = [F.count_if(F.col("longer") == i).over(mine) for i in range(LONGER + 1)]
    asked = cut(met.withColumn("asked", F.least("longer", cap_for(shared, threshold, trees, depth, recall) - depth)))
    levels = F.explode(F.sequence(F.lit(0), F.col("longer")))
    prefix = F.expr(f"shiftright(tail, 16 * ({LONGER} - level))")
    nodes = asked.select("c", "node", "tail", "asked", levels.alias("level")).select("c", "node", prefix.alias("prefix"), "level", (F.col("asked") == F.col("level")).alias("wanted"))
    hubs = nodes.groupBy("node", "level", "prefix").agg(F.min("c").alias("hub"), F.max("wanted").alias("_w")).filter("_w").drop("_w")
    return nodes.join(hubs, ["node", "level", "prefix"]).filter("c <> hub").select(F.col("c").alias("u"), F.col("hub").alias("v")).distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets in ``a`` with all in ``b`` (or in ``a``), by products over shared shingles."""
    sets = a + (b or [])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, local, df = np.unique(flat, return_inverse=True, return_counts=True)
    keep = df[local] > 1
    names, local = np.unique(local[keep], return_inverse=True)
    who = who[keep]
    order = np.argsort(local, kind="stable")
    local, who = local[order], who[order]
    out = np.zeros((len(a), len(b or a)), np.float32)
    step = 2048
    for lo in range(0, len(names), step):
        i, j = np.searchsorted(local, [lo, lo + step])
        rows, at = np.unique(who[i:j], return_inverse=True)
        x = np.zeros((len(rows), step), np.float32)
        x[at, local[i:j] - lo] = 1
        left = rows < len(a)
        if b is None:
            out[np.ix_(rows, rows)] += x @ x.T
        elif left.any() and not left.all():
            out[np.ix_(rows[left], rows[~left] - len(a))] += x[left] @ x[~left].T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: Fraction) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold."""
    common = common_counts(a, b).astype(np.int64)
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in (b or a)])
    out = common * (threshold.numerator + threshold.denominator) >= threshold.numerator * (na[:, None] + nb[None, :])
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _roots(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[cols])
        np.minimum.at(low, cols, label[rows])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def join_documents(docs: DataFrame, threshold: str = THRESHOLD, trees: int = TREES, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, class_id, n_links, n_copies) of every document row; th is the text's hash.

    class_id: smallest id in the document's component of links at or above the threshold. n_links: number of other
    document rows linked to it directly, same-set copies included; n_copies of them have its very shingle set.
    Documents without words (null or empty texts too) have no links and stand alone; null ids take part but never name a
    class that has another id; equal rows count as copies; similarity exactly at the threshold counts (compared as
    integers); an empty table gives an empty result; other columns are not read.
    """
    batched(docs.sparkSession)
    ratio = Fraction(threshold)
    depth = depth_for(float(ratio), trees, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    signed = cut(signatures(docs, id_col, text_col, trees, depth))
    classes = cut(signed.groupBy("c").agg(F.min_by(F.struct("id", "th"), F.struct("id", "th")).alias("rep"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    families = components(trie_links(classes, float(ratio), trees, depth, recall)).select(F.col("node").alias("c"), F.col("root").alias("family"))
    weight = F.greatest("n", F.lit(300))
    members = cut(classes.drop("keys").join(families, "c"))
    sizes = members.groupBy("family").agg(F.sum(weight).alias("w")).withColumn("nb", F.ceil(F.col("w") / BLOCK_WEIGHT).cast("int"))
    wanted = cut(members.join(sizes, "family").select("c", "family", "size", "nb", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"), weight.alias("w")))
    total = wanted.agg(F.sum("w")).first()[0] or 0
    packs = max(1, int(total // BLOCK_WEIGHT))

    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    picked = texts.join(small(wanted.drop("w")), F.col("_id").eqNullSafe(F.col("rid")) & (F.col("_th") == F.col("rth"))).select("c", "family", "size", "nb", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("_text"))
            for i, j in arrays.chunks(offsets):
                values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                blobs = pa.array([values[bounds[r] : bounds[r + 1]].tobytes() for r in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(x).slice(i, j - i) for x in ("c", "family", "size", "nb")], blobs], ["c", "family", "size", "nb", "sets"])

    sets_of = picked.mapInArrow(sets, "c binary, family binary, size long, nb int, sets binary")
    mine = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    dealt = sets_of.withColumn("b", mine).withColumn("p", F.explode(pairs))
    pack = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(-1)
    group = [pack.alias("pack"), F.when(F.col("nb") > 1, F.col("family")).alias("fam"), F.col("p.i").alias("i"), F.col("p.j").alias("j")]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.drop_duplicates("c")
        for _, fam in pdf.groupby("family", sort=False):
            c, size = fam["c"].to_list(), fam["size"].to_numpy()
            got = [np.frombuffer(x, np.uint64) for x in fam["sets"]]
            b, i, j = fam["b"].to_numpy(), fam["i"].iloc[0], fam["j"].iloc[0]
            if i == j:
                at = linked(got, None, ratio)
                rows, cols = np.nonzero(at)
                links = at @ size
            else:
                left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
                links = np.zeros(len(c), np.int64)
                rows = cols = np.zeros(0, np.int64)
                if len(left) and len(right):
                    at = linked([got[x] for x in left], [got[x] for x in right], ratio)
                    links[left], links[right] = at @ size[right], size[left] @ at
                    rows, cols = np.nonzero(at)
                    rows, cols = left[rows], right[cols]
            root = _roots(len(c), rows, cols)
            out.append(pd.DataFrame({"c": c, "links": links, "root": [c[r] for r in root]}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "links": [], "root": []})

    grouped = dealt.select(*group, "c", "family", "size", "b", "sets").repartition(max(parts(docs.sparkSession), packs), "pack", "fam", "i", "j").groupBy("pack", "fam", "i", "j")
    verified = cut(grouped.applyInPandas(verify, "c binary, links long, root binary"))
    roots = components(verified.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "c")
    linked_to = verified.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "low", "size").join(linked_to, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = named.groupBy("root").agg(F.min("low").alias("class_id"))
    of_class = cut(named.join(names, "root").select("c", "class_id", (F.col("size") - 1).alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    with_words = signed.select("id", "th", "c").join(of_class, "c").select("id", "th", "class_id", "n_links", "n_copies")
    has_words = F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), F.lit(False))
    zero = F.lit(0).cast("long")
    without = docs.filter(~has_words).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(id_col).cast(kind).alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return with_words.unionByName(without).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those whose component of near copies has a smaller id: one document of each stays.

    Rows that repeat both id and text are one document. Texts without words stay. All columns stay, whatever their names;
    an empty table gives an empty result. The removed keys are joined back as a narrow table.
    """
    joined = join_documents(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    gone = cut(joined.filter(F.col("class_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("gid"), F.col("th").alias("gth")).distinct())
    rows = packed(docs, id=F.col(id_col), th=F.xxhash64(text_col))
    return rows.join(small(gone), F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left_anti").select("_row.*")
