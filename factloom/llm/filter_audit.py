"""Filter interaction audit: what each of five document filters removes in each of the 120 orders they can run in.

Filters A to D look at one text and are column expressions; E fails a text that a smaller id has too. E is decided on an RDD
routed by fingerprint: a task keeps, for every xxhash64 of a text, the chain of the different texts that have it, each whole and
with its smallest id, and emits every other id. Each task does so over its own part of the input first, so a group of copies,
however large, sends one row a task to the task that decides, and rows already decided travel by a spread key without their
text. Then every row is a mask of failed filters, and combineByKey adds up one vector of mask counts a part. All that is asked
of any order is a sum over that vector.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import parts

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LOCAL_BYTES = 64 << 20  # text that a task keeps before the shuffle; then it sends what it has and starts again
ROUTED_BYTES = 64 << 20  # text that a task after the shuffle is meant to get; more text, more tasks

_SPACE = "[\\x20\\x09-\\x0D]+"


def text_mask(text: Column) -> Column:
    """The failed filters of A to D as bits."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [
        lambda w: F.size(w) < 100,
        lambda w: F.size(F.array_distinct(w)) * 100 < F.size(w) * 80,
        lambda w: capitals * 100 > F.length(text) * 10,
        lambda w: text.rlike("[#$%&*|]"),
    ]
    mask = lambda w: sum((F.when(fail(w), 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return F.get(F.transform(F.array(words), mask), 0)  # the words are made once


class _Chains:
    """Different texts by fingerprint, each with its smallest id, that id's rows by part, and its mask."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def meet(self, fingerprint: int, text: str, doc_id, rows: dict, mask: int) -> Iterator[tuple]:
        """Takes in rows of one id and text; the rows that are thereby known to be repeats come out."""
        chain = self.by_print.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, dict(rows), mask])
            self.bytes += len(text) + 200
        elif doc_id == entry[1]:
            for part, n in rows.items():
                entry[2][part] = entry[2].get(part, 0) + n
        else:
            lost_id, lost = doc_id, rows
            if doc_id < entry[1]:
                lost_id, lost = entry[1], entry[2]
                entry[1], entry[2] = doc_id, dict(rows)
            for part, n in lost.items():
                yield lost_id, part, mask | REPEATED, n

    def entries(self) -> Iterator[tuple]:
        for fingerprint, chain in self.by_print.items():
            for text, doc_id, rows, mask in chain:
                yield fingerprint, text, doc_id, rows, mask


def _send(rows: Iterable) -> Iterator[tuple]:
    """Of one input task: decided rows under a spread key, and one row a text under its fingerprint."""
    chains, spread = _Chains(), itertools.count()
    for fingerprint, text, doc_id, part, mask in rows:
        if doc_id is None:
            yield next(spread), (None, None, {part: 1}, mask)
            continue
        for lost_id, lost_part, lost_mask, n in chains.meet(fingerprint, text, doc_id, {part: 1}, mask):
            yield next(spread), (None, lost_id, {lost_part: n}, lost_mask)
        if chains.bytes > LOCAL_BYTES:
            for fingerprint, *entry in chains.entries():
                yield fingerprint, tuple(entry)
            chains = _Chains()
    for fingerprint, *entry in chains.entries():
        yield fingerprint, tuple(entry)


def _decide(rows: Iterable) -> Iterator[tuple]:
    chains = _Chains()
    for fingerprint, (text, doc_id, counts, mask) in rows:
        if text is None:
            yield from ((doc_id, part, mask, n) for part, n in counts.items())
        else:
            yield from chains.meet(fingerprint, text, doc_id, counts, mask)
    for _, _, doc_id, counts, mask in chains.entries():
        yield from ((doc_id, part, mask, n) for part, n in counts.items())


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): rows of ``docs`` with the filters they fail; n rows agree in all three columns."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text), text, F.col(id_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")), text_mask(text))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()["bytes"]
    width = max(parts(spark), -(-total // ROUTED_BYTES))
    decided = rows.rdd.mapPartitions(_send).partitionBy(width, lambda key: key % width).mapPartitions(_decide)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(decided, schema, verifySchema=False)


def repeated_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id): one row for every row of ``docs`` whose text a smaller id has too."""
    found = failed_filters(docs.select(F.col(id_col), F.col(text_col), F.lit("").alias("_part")), id_col, text_col, "_part")
    return found.filter(F.col("mask").bitwiseAND(REPEATED) != 0).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id")


def _order_rows(part: str, counts: list[int]) -> Iterator[tuple]:
    """The 600 rows of a part: every order, every step. ``counts`` has all rows, good ones and toxic ones by mask."""
    n, good, toxic = (counts[i * MASKS : (i + 1) * MASKS] for i in range(3))
    seen_sets = range(MASKS)
    bits = [1 << i for i in range(len(FILTERS))]
    removed = {(b, s): [sum(c[m] for m in range(MASKS) if m & b and not m & s) for c in (n, good, toxic)] for b in bits for s in seen_sets}
    failing = {b: sum(n[m] for m in range(MASKS) if m & b) for b in bits}
    orders = list(itertools.permutations(bits))
    shapley = {b: sum(removed[b, sum(order[: order.index(b)])][0] for order in orders) for b in bits}
    for order in orders:
        name = "".join(FILTERS[b.bit_length() - 1] for b in order)
        for step, b in enumerate(order, 1):
            seen = sum(order[: step - 1])
            gone, good_lost, toxic_lost = removed[b, seen]
            kept = sum(n[m] for m in range(MASKS) if not m & (seen | b))
            yield part, name, step, kept, gone, failing[b] - gone, n[b], good_lost, toxic_lost, shapley[b]


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; parts are the values of ``part_col`` (null: the empty string).

    A null text is the empty text, which fails A only, and E if a smaller id has it. Rows with a null id never fail E and make
    no other fail it; rows that repeat id and text fail or pass E together, and each counts. An id with several labels is good
    (toxic) if one of them says so; a null label says nothing. Other columns of ``docs`` are not read, whatever their names.
    Texts of any length are compared whole. An empty table has no part and gives no rows.
    """
    spark = docs.sparkSession
    found = failed_filters(docs, id_col, text_col, part_col)
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = told.filter("good + toxic > 0")
    rows = found.join(told, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(counts: list[int], row: tuple) -> list[int]:
        mask, n, good, toxic = row
        counts[mask] += n
        counts[MASKS + mask] += n * good
        counts[2 * MASKS + mask] += n * toxic
        return counts

    merge = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    by_part = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add([0] * (3 * MASKS), row), add, merge, parts(spark))
    return spark.createDataFrame(by_part.flatMap(lambda x: _order_rows(*x)), COLUMNS, verifySchema=False)
