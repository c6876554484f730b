"""Line dedup by winnowing over line hashes (DataFrame functions only).

A run of at least ``window`` lines that also starts earlier (smaller id, or same document and earlier line) is deleted, and
so is a shorter run of more than ``words`` words. Every ``window`` consecutive lines select their line of smallest hash
(rightmost on ties), so equal windows select the same line, and each window belongs to one selected position. Positions are
joined with the fingerprints that repeat; a position that stays is extended both ways over the windows it owns. A shorter
run of many words is a window that is its own fingerprint. A window's first place is one aggregated minimum, and each later
place of it deletes its lines; overlapping windows make up the maximal runs. The first place of a window stands for all
others, so no pair of occurrences is formed, however often a line repeats; both joins deal the rows of hot keys anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, salted_join

WINDOW = 3
WORDS = 50
BROADCAST_LINES = 4_000_000  # removed line numbers (4 bytes each) that are broadcast at most; beyond, a shuffled join


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def removed_lines(docs: DataFrame, window: int = WINDOW, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _t, _removed): the sorted line numbers that go, for each document (id and text hash) that loses lines.

    Arrays are exploded with explode_outer: for explode, Spark infers a filter on the array's size and pushes it below the
    projection that makes the lines' hashes, which would then be made anew for every line.
    """
    text = F.col(text_col)
    split = docs.filter(text.isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), _lines(text).alias("_lines"))
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    each = F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"), n_words(x).alias("n")))
    hashed = split.select("_id", "_t", each.alias("_h"), F.size("_lines").alias("_size"))

    def keys(at, lines: int) -> list[Column]:
        """Two hashes of a window of ``lines`` lines; ``at`` gives its lines."""
        return [F.xxhash64(F.lit(lines), *[at(j)["h"] for j in range(lines)]).alias("_k1"), F.xxhash64(F.lit(lines), *[at(j)["g"] for j in range(lines)]).alias("_k2")]

    def selected(at, i: Column) -> Column:
        """The line that the window at ``i`` selects."""
        return -F.least(*[F.struct(at(i + j)["h"].alias("h"), (-(i + j)).alias("p")) for j in range(window)])["p"]

    long_enough = hashed.filter(F.col("_size") >= window)
    line = lambda i: F.get("_h", i)
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_size") - window), lambda i: selected(line, i)))
    low = lambda p: F.greatest(p - (window - 1), F.lit(0))
    place_of = lambda p: F.struct(line(p)["h"].alias("_fp"), p.alias("_at"), low(p).alias("_low"), F.slice("_h", low(p) + 1, p - low(p) + window).alias("_around"))
    chosen = long_enough.withColumn("_chosen", chosen)
    positions = chosen.select("_id", "_t", F.explode_outer(F.transform("_chosen", place_of)).alias("_p")).filter("_p is not null").select("_id", "_t", "_p.*")

    repeated = cut(chosen.select(F.explode_outer(F.transform("_chosen", lambda p: line(p)["h"])).alias("_fp")).filter("_fp is not null").groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = repeated.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hits = salted_join(positions, repeated.select("_fp"), ["_fp"], repeated, total, ["_id", "_t", "_at"], "left_semi")

    def owned(i: Column) -> Column:
        at = lambda j: F.get("_around", j)
        return F.struct((F.col("_low") + i).alias("_start"), (selected(at, i) + F.col("_low") == F.col("_at")).alias("_own"), *keys(lambda j: at(i + j), window))

    wins = hits.select("_id", "_t", "_at", "_low", "_around").withColumn("_w", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("_around") - window), owned)))
    wins = wins.filter("_w._own").select("_id", "_t", "_w._start", F.lit(window).alias("_lines"), "_w._k1", "_w._k2")

    def short(lines: int) -> DataFrame:
        """Windows of ``lines`` lines that have many words."""
        many = lambda i: sum((line(i + j)["n"] for j in range(1, lines)), line(i)["n"]) > words
        window_at = lambda i: F.struct(i.alias("_start"), *keys(lambda j: line(i + j), lines))
        found = hashed.filter(F.col("_size") >= lines).withColumn("_starts", F.filter(F.sequence(F.lit(0), F.col("_size") - lines), many))
        found = found.select("_id", "_t", F.explode_outer(F.transform("_starts", window_at)).alias("_w"))
        return found.filter("_w is not null").select("_id", "_t", "_w._start", F.lit(lines).alias("_lines"), "_w._k1", "_w._k2")

    for lines in range(1, min(window, 3)):
        wins = wins.unionByName(short(lines))
    wins = cut(wins)
    place = F.struct("_id", "_t", "_start")
    firsts = cut(wins.groupBy("_k1", "_k2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = firsts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    later = salted_join(wins, firsts.drop("_n"), ["_k1", "_k2"], firsts, total, ["_id", "_t", "_start"]).filter(~place.eqNullSafe(F.col("_first")))
    covered = F.flatten(F.transform(F.collect_set(F.struct("_start", "_lines")), lambda w: F.sequence(w["_start"], w["_start"] + w["_lines"] - 1)))
    return later.groupBy("_id", "_t").agg(F.array_sort(F.array_distinct(covered)).alias("_removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines, n_removed and n_runs (maximal removed runs).

    A null text has no lines and stays null; an empty text is one empty line; a document of fewer than ``window`` lines can
    only lose runs of more than ``words`` words (pieces between single spaces). Documents are told apart by id and text
    (null ids sort first): rows that repeat both are one document. Ties in hashes go to the later line, so the choice depends
    on the lines only. Input columns with the names of the new ones are replaced, those with names of the operator's own
    columns stay; an empty table gives an empty result.
    """
    new = ["kept_text", "n_lines", "n_removed", "n_runs"]
    kept_columns = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text_col).alias("_rt"), F.col(text_col).alias("_text"))
    gone = cut(removed_lines(docs.select(id_col, text_col), window, words, id_col, text_col))
    amount = gone.agg(F.coalesce(F.sum(F.size("_removed") + 8), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if amount <= BROADCAST_LINES else gone
    joined = rows.join(gone, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rt") == F.col("_t")), "left")
    index = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_removed")
    kept = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(index, lambda i: F.get("_split", i)), "\n"))
    breaks = F.size(F.array_except("_removed", F.transform("_removed", lambda i: i + 1)))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_split"))
    return joined.withColumn("_split", _lines(F.col("_text"))).select(
        "_row.*",
        kept.alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long").alias("n_removed"),
        F.when(F.col("_removed").isNull(), 0).otherwise(breaks).cast("long").alias("n_runs"),
    )
