"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Every row gets a global number that depends on the rows alone, a Feistel network permutes the numbers, and the permuted
number gives shard (modulo the shard count) and slot (the quotient). Shard sizes differ by one row at most, slots have
no gaps, and ``position`` can be computed for any number without touching other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut

PRIME = 2147483647
ROUNDS = 8
WALKS = 16
BUCKETS = 4096


def _keys(seed: int) -> list[tuple[int, int, int]]:
    """(add, multiply, side) of each round, from a linear congruential sequence."""
    out, x = [], (seed * 2654435761 + 97) % PRIME
    for i in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        add = x
        x = (x * 48271 + 11) % PRIME
        out.append((add, x | 1, i % 2))
    return out


def permute(index: Column, n: int, seed: int) -> Column:
    """The Feistel image of ``index`` in [0, n), by cycle walking.

    The halves are Z_a and Z_b with a = ceil(sqrt n) and b = ceil(n / a), so fewer than a of the a * b points lie outside
    [0, n) and a walk of more than ``WALKS`` steps needs that many hits on a set of share 1 / a: such an index raises an
    error instead of leaving the range.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("add"), F.lit(m).cast("long").alias("mul"), F.lit(s).alias("side")) for x, m, s in _keys(seed)])

    def scramble(v: Column, k: Column) -> Column:
        t = ((v + k["add"]) % PRIME) * k["mul"] % PRIME
        return (t * t % PRIME + k["add"]) % PRIME

    def once(x: Column) -> Column:
        def round_(s: Column, k: Column) -> Column:
            right = F.pmod(s, F.lit(b).cast("long"))
            left = ((s - right) / F.lit(b)).cast("long")
            return F.when(k["side"] == 0, (left + scramble(right, k)) % a * b + right).otherwise(left * b + (right + scramble(left, k)) % b)

        return F.aggregate(keys, x, round_)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(index), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk left its range")).cast("long"))


def number_rows(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` (0 to n - 1) and n. ``order`` must name all columns that tell rows apart.

    Identical rows are counted first and share a block of numbers, so one key with a third of all rows is one partial sum.
    Rows fall into a fixed number of hash buckets; bucket totals (at most ``buckets`` rows) are added up on the driver.
    """
    spark = df.sparkSession
    same = cut(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))))
    sizes = {r[0]: r[1] for r in same.groupBy("_bucket").agg(F.sum("_copies").alias("n")).collect()}
    offsets, total = [], 0
    for b in sorted(sizes):
        offsets.append((b, total))
        total += sizes[b]
    if not total:
        return df.withColumn("row_number", F.lit(0).cast("long")), 0
    base = F.broadcast(spark.createDataFrame(offsets, "_bucket long, _base long"))
    up_to = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = same.join(base, "_bucket").withColumn("_first", F.col("_base") + F.coalesce(F.sum("_copies").over(up_to), F.lit(0)))
    numbered = first.withColumn("row_number", F.explode(F.sequence("_first", F.col("_first") + F.col("_copies") - 1)))
    return numbered.select(*df.columns, "row_number"), total


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document.

    Returns ``id_col``, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard, row_number.
    Law ``rows``: shard sizes differ by at most one row; grown_shard is null. A null text counts as empty; null ids and
    repeated rows are numbered like all others (identical rows get neighbouring numbers, then different places); an empty
    table gives an empty result; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    numbered, n = number_rows(narrow, [id_col, "text_crc32", "size"])
    place = permute(F.col("row_number"), n, seed) if n else F.lit(0).cast("long")
    return numbered.withColumn("_place", place).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
