"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive item words (a shorter item is one window). Every window selects, of its ``gram``-word
hashes, the smallest (rightmost on ties): a document that shares a window shares its fingerprint at the same distance. Both
sides are fingerprinted in tasks and joined by fingerprint: the benchmark's fingerprints are broadcast where they are
``BROADCAST_PRINTS`` at most, else the documents' ones are joined with them in a shuffle. Each hit is extended to the windows that
select it, which are joined by their 128-bit hashes with the benchmark's. Shorter items are fingerprinted whole. Only
hashes and ids are shuffled; equal texts on either side are looked up once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, cut, packed, salted_join, small, text_key

SPAN = 10
GRAM = 5
BROADCAST_PRINTS = 4_000_000  # of eight bytes each
WINDOWS = "fp long, at int, n int, w1 long, w2 long"


def windows_of(hashes: np.ndarray, bounds: np.ndarray, span: int, gram: int, lengths: list[int], known: Callable | None) -> tuple[np.ndarray, ...]:
    """(row, start in the row, words, fingerprint, hash, second hash) of the windows of all rows.

    ``lengths``: the lengths below ``span`` of which windows are wanted, each its own fingerprint. ``known`` tells which of
    the fingerprints of windows of some length are wanted; None: all.
    """
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    second = arrays.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    found = []
    for n in [span, *lengths]:
        if len(hashes) < n:
            continue
        if n == span:
            g = arrays.grams(hashes, gram)
            fp = g[arrays.sliding_min_rightmost(g, span - gram + 1)]
        else:
            fp = arrays.grams(hashes, n) + np.uint64(n)
        ok = row[: len(fp)] == row[n - 1 :]
        if known is not None:
            ok &= known(n, fp)
        at = np.flatnonzero(ok)
        keys = []
        for h in (hashes, second):
            out = np.full(len(at), n, np.uint64)
            for j in range(n):
                out = out * arrays.BASE + h[at + j]
            keys.append(arrays.mix(out))
        found.append((row[at], at - bounds[row[at]], np.full(len(at), n), fp[at], *keys))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
    return tuple(np.concatenate([f[i] for f in found] + [np.zeros(0, k)]) for i, k in enumerate(kinds))


def benchmark_windows(benchmark: DataFrame, span: int, gram: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(c1, c2, fp, at, n, w1, w2) of the distinct item texts, and (c1, c2, item) of all items; a null id is ``null``."""
    key = text_key(text_col)
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key["t1"].alias("c1"), key["t2"].alias("c2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("text"))
            for i, j in arrays.chunks(offsets):
                h, bounds = arrays.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                few = np.unique(np.diff(bounds))
                few = [int(n) for n in few if 0 < n < span]
                row, at, n, fp, w1, w2 = windows_of(h, bounds, span, gram, few, None)
                whole = (n == span) | (n == np.diff(bounds)[row])
                take = pa.array(row[whole] + i)
                cols = [pa.array(x[whole].view(np.int64)) for x in (fp, w1, w2)]
                ints = [pa.array(x[whole].astype(np.int32)) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([b.column("c1").take(take), b.column("c2").take(take), cols[0], *ints, *cols[1:]], ["c1", "c2", "fp", "at", "n", "w1", "w2"])

    windows = texts.dropDuplicates(["c1", "c2"]).select("c1", "c2", "text").mapInArrow(run, f"c1 long, c2 long, {WINDOWS}")
    return cut(windows.select("c1", "c2", "fp", "n", "w1", "w2").distinct()), texts.select("c1", "c2", "item").distinct()


def matched_texts(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, text_col: str, item_col: str) -> DataFrame:
    """(t1, t2, hits, items): the document texts that share a window, with the windows' (at, n) and the sorted item ids."""
    windows, items = benchmark_windows(benchmark, span, gram, item_col, "text" if text_col not in benchmark.columns else text_col)
    prints = windows.select("n", "fp").distinct()
    lengths = sorted(r[0] for r in windows.filter(F.col("n") < span).select("n").distinct().collect())
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in text_key(text_col).items()])
    shared = None
    if prints.count() <= BROADCAST_PRINTS:
        table = prints.toArrow()
        n, fp = table["n"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast({int(k): np.sort(fp[n == k]) for k in np.unique(n)})

    def in_table(table: dict[int, np.ndarray]) -> Callable:
        def known(n: int, fp: np.ndarray) -> np.ndarray:
            keys = table.get(n, np.zeros(0, np.uint64))
            if not len(keys):
                return np.zeros(len(fp), bool)
            at = np.searchsorted(keys, fp)
            return keys[np.minimum(at, len(keys) - 1)] == fp

        return known

    def found(only_prints: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = arrays.text_buffers(b.column("text"))
                for i, j in arrays.chunks(offsets):
                    h, bounds = arrays.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    known = None
                    if shared is not None:
                        known = in_table(shared.value)
                    elif not only_prints:
                        of = b.column("fps").slice(i, j - i).flatten()
                        n, fp = of.field("n").to_numpy(), of.field("fp").to_numpy().view(np.uint64)
                        known = in_table({int(k): np.unique(fp[n == k]) for k in np.unique(n)})
                    row, at, n, fp, w1, w2 = windows_of(h, bounds, span, gram, lengths, known)
                    if only_prints:
                        keep = np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])]) if len(fp) else np.zeros(0, bool)
                        row, at, n, fp, w1, w2 = (x[keep] for x in (row, at, n, fp, w1, w2))
                    take = pa.array(row + i)
                    ints = [pa.array(x.astype(np.int32)) for x in (at, n)]
                    cols = [pa.array(x.view(np.int64)) for x in (fp, w1, w2)]
                    yield pa.RecordBatch.from_arrays([b.column("t1").take(take), b.column("t2").take(take), cols[0], *ints, *cols[1:]], ["t1", "t2", "fp", "at", "n", "w1", "w2"])

        return run

    schema = f"t1 long, t2 long, {WINDOWS}"
    if shared is None:
        hit = source.mapInArrow(found(True), schema).select("t1", "t2", "n", "fp").distinct().join(prints, ["n", "fp"], "left_semi")
        hit = hit.groupBy("t1", "t2").agg(F.collect_set(F.struct("n", "fp")).alias("fps"))
        source = source.join(hit, ["t1", "t2"])
    asked = cut(source.mapInArrow(found(False), schema).select("t1", "t2", "at", "n", "w1", "w2").distinct())
    counts = cut(asked.groupBy("n", "w1", "w2").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    spans = salted_join(asked, windows.select("n", "w1", "w2").distinct(), ["n", "w1", "w2"], counts, total, ["t1", "t2", "at"], "left_semi")
    hits = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    classes = salted_join(asked, windows.select("n", "w1", "w2", "c1", "c2"), ["n", "w1", "w2"], counts, total, ["t1", "t2", "at"]).select("t1", "t2", "c1", "c2").distinct()
    names = classes.join(items, ["c1", "c2"]).groupBy("t1", "t2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hits.join(names, ["t1", "t2"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and are clean; items without words match nothing; repeated item ids count once;
    repeated document rows each get their result; an empty benchmark or table gives clean or no rows. Input columns with
    the names of the new ones are replaced.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    batched(docs.sparkSession)
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    matched = matched_texts(docs, benchmark, span, gram, text_col, item_col)
    matched = matched.select("t1", "t2", "hits", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = packed(own, **text_key(text_col), text=F.coalesce(F.col(text_col), F.lit(""))).join(small(cut(matched), 100_000), ["t1", "t2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("text"))
            starts, _ = arrays.spans(data, offsets, arrays.WORD)
            n_words = np.diff(np.searchsorted(starts, offsets))
            n_hit = [_covered(h) for h in b.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(n_words), pa.array(n_hit, pa.int64()), b.column("n_items"), b.column("items_sha256")], ["_row", *new[:4]])

    schema = rows.select("_row").schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")
    counted = rows.select("_row", "text", "hits", "n_items", "items_sha256").mapInArrow(run, schema)
    return counted.select("_row.*", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text shares a window with an item; all columns stay, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark leaves all rows.
    """
    batched(docs.sparkSession)
    gone = cut(matched_texts(docs, benchmark, span, gram, text_col, item_col).select("t1", "t2"))
    return packed(docs, **text_key(text_col)).join(small(gone), ["t1", "t2"], "left_anti").select("_row.*")


def _covered(hits: list[dict] | None) -> int:
    """Words in the union of the windows."""
    total, end = 0, -1
    for at, n in sorted((h["at"], h["n"]) for h in hits or ()):
        total += max(0, at + n - max(at, end))
        end = max(end, at + n)
    return total
