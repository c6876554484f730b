"""Language-model scoring by prediction by partial matching, beside a smoothed unigram base score.

Spark counts the byte contexts of the training documents (an order-K trie, one row for each context and next byte) and
works out the code length of every byte in every context that some document asks for: escape estimation by method C, going
down the orders with symbol exclusion, to a uniform code over the bytes that are left. A document's score is then a sum of
look-ups over its whole text and an end mark; the texts are pretrained-coded, so documents don't depend on another.

The order is the same at every size, and every context counts, also one that occurred once. Neither the trie nor the
unigram counts have a size bound, so they are never broadcast: documents are dealt into blocks of about ``BLOCK_BYTES``, each
block sends its distinct grams and words with their counts to these's partitions, and only their code lengths, and the
words whose total differs from the block's own count, come back. A word or gram has at most one row for each block, so none
is hotter than the number of blocks. The counts of three bytes alone (2**24 cells at most) go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, crc_fold, parts

ORDER = 5
LOW = 2  # contexts up to this length come from the counts that all tasks have
END = 0xFF  # never a byte of UTF-8: ends a text
PAD = 0xFE  # never a byte of UTF-8: stands before a text
BLOCK_BYTES = 32 << 20
SLICE = 1 << 16


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, lower-cased, each after ``order`` PAD bytes and before END; and the rows' offsets."""
    n = len(offsets) - 1
    size = np.diff(offsets) + order + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], PAD, np.uint8)
    where = np.repeat(at[:-1] + order - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
    out[where] = arrays.LOWER[data]
    out[at[1:] - 1] = END
    assert len(at) == n + 1
    return out, at


def counted_grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n): counts of order + 1 consecutive bytes of ``_text``, packed big-endian into a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally()
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("_text"))
            for i, j in arrays.chunks(offsets):
                packed, _ = packed_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                total.add(*flagged(packed, np.ones(len(packed), bool), order))
                if total.size > 4_000_000:
                    yield _counts(*total.take())
        yield _counts(*total.take())

    return docs.select("_text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])


def _group(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights by key."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def flagged(packed: np.ndarray, flags: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the number of their set flags; grams of six bytes are sorted with the flag in their lowest bit."""
    if order > 5:
        return _group(packed, flags.astype(np.int64))
    s = np.sort((packed << np.uint64(1)) | flags)
    key = s >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat((s & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Tally:
    """Sums by key of many small tables, merged when they outweigh what is merged already."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.waiting.append((keys, sums))
        self.size += len(keys)
        if self.size > 2 * len(self.keys) + 1_000_000:
            self.merge()

    def merge(self) -> None:
        self.keys, self.sums = _group(np.concatenate([self.keys, *[k for k, _ in self.waiting]]), np.concatenate([self.sums, *[c for _, c in self.waiting]]))
        self.waiting, self.size = [], len(self.keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """What was summed; the tally is empty after."""
        self.merge()
        out = self.keys, self.sums
        self.__init__()
        return out


def packed_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order + 1 bytes that end at each byte of the texts and at their ends, packed big-endian; and their rows."""
    text, at = padded(data, offsets, order)
    packed = np.zeros(max(len(text) - order, 0), np.uint64)
    for k in range(order + 1):
        packed = (packed << np.uint64(8)) | text[k : k + len(packed)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)
    return packed[np.arange(len(row)) + row * order], row


def gram_costs(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of the last byte of each distinct gram after those before it.

    ``grams`` (any order of rows, count 0 where the training texts lack it) hold all trained grams whose contexts end in the
    same ``LOW`` + 1 bytes as one of them; ``low`` are the counts of all grams of order ``LOW`` of the training texts, sorted.
    """
    grams = grams.astype(np.uint64)
    mask = [np.uint64((1 << (8 * k)) - 1) for k in range(order + 2)]
    eight, trained = np.uint64(8), counts > 0
    levels = []
    for k in range(order + 1):
        source = (low[0].astype(np.uint64), low[1]) if k <= LOW else (grams[trained], counts[trained])
        keys, n = _group(source[0] & mask[k + 1], source[1])
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] >> eight != keys[:-1] >> eight])) if len(keys) else np.zeros(0, np.int64)
        contexts = keys[edge] >> eight
        levels.append((keys, n, edge, contexts, np.add.reduceat(n, edge) if len(edge) else n, np.diff(np.append(edge, len(keys)))))

    def find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
        return np.where(sorted_[at] == wanted, at, -1)

    out, escape, done, above = np.zeros(len(grams)), np.zeros(len(grams)), np.zeros(len(grams), bool), np.full(len(grams), -1)
    for k in range(order, -1, -1):
        keys, n, _, contexts, total, distinct = levels[k]
        here = find(contexts, (grams >> eight) & mask[k])
        at = find(keys, grams & mask[k + 1])
        live, left = np.where(here >= 0, total[here] if len(total) else 0, 0), np.where(here >= 0, distinct[here] if len(total) else 0, 0)
        if k < order and len(levels[k + 1][0]):
            # What the next longer context has seen is excluded; its symbols are among this context's.
            upper, _, edge, longer, _, theirs = levels[k + 1]
            under = n[find(keys, upper & mask[k + 1])]
            known = above >= 0
            live = live - np.where(known, np.add.reduceat(under, edge)[above], 0)
            left = left - np.where(known, theirs[above], 0)
        base = np.maximum(live + left, 1)
        hit = (at >= 0) & ~done
        out[hit] = escape[hit] + np.log10(n[at[hit]] / base[hit])
        done |= hit
        escape += np.log10(np.where(left > 0, left, 1) / np.where(left > 0, base, 1))
        above = here
    out[~done] = escape[~done] - np.log10(max(256 - len(levels[0][0]), 1))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased space-separated words, and each row's first word (n + 1 bounds)."""
    data = arrays.LOWER[data]
    starts, ends = arrays.spans(data, offsets, ~arrays.SPACE)
    return arrays.span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def block_counts(pieces):
    """(block, w, c): every key of each block with its number of training occurrences in the task's rows.

    ``pieces`` gives the keys of some texts, the row of each, and distinct keys with the number of set flags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Tally] = {}
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("_text"))
            block, trains = b.column("block").to_numpy(), ~b.column("held_out").to_numpy(zero_copy_only=False)
            for i, j in arrays.chunks(offsets):
                keys, row, grouped = pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flags, names = trains[i:j][row], np.unique(block[i:j]).tolist()
                for k in names:
                    mine = block[i:j][row] == k if len(names) > 1 else slice(None)
                    held.setdefault(k, Tally()).add(*grouped(keys[mine], flags[mine]))
            while sum(t.size for t in held.values()) > 6_000_000:
                k = max(held, key=lambda k: held[k].size)
                yield _rows(k, *held.pop(k).take())
        for k, t in held.items():
            yield _rows(k, *t.take())

    return run


def _rows(block: int, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block, np.int64)), pa.array(w.view(np.int64)), pa.array(c)], ["block", "w", "c"])


def gram_pieces(order: int):
    def pieces(data: np.ndarray, offsets: np.ndarray):
        packed, row = packed_grams(data, offsets, order)
        return packed, row, lambda keys, flags: flagged(keys, flags, order)

    return pieces


def word_pieces(data: np.ndarray, offsets: np.ndarray):
    h, bounds = tokens(data, offsets)
    return h, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), lambda keys, flags: _group(keys, flags.astype(np.int64))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, order: int) -> np.ndarray:
    """Values of the wanted grams among sorted keys that hold them all; each slice is looked up in its own order."""
    out = np.empty(len(wanted), values.dtype)
    for a in range(0, len(wanted), SLICE):
        part = wanted[a : a + SLICE]
        if order > 5:
            out[a : a + len(part)] = values[np.searchsorted(keys, part)]
            continue
        packed = np.sort((part << np.uint64(16)) | np.arange(len(part), dtype=np.uint64))
        out[a + (packed & np.uint64(SLICE - 1)).astype(np.int64)] = values[np.searchsorted(keys, packed >> np.uint64(16))]
    return out


def score_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Training rows are those outside fold 2 of 7. Null texts are empty: one end token and the end symbol. Null ids are
    folded by a fixed text, repeated rows count as often as they occur (rows that repeat id and text are in one block),
    other columns are not read, and an empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    batched(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), (crc_fold(id_col, 7) == 2).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sizes = rows.agg(F.coalesce(F.sum(F.octet_length("_text") + 16), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    blocks, ends = max(1, -(-sizes[0] // block_bytes)), sizes[1]
    width = max(parts(spark), 4 * blocks)
    counted = counted_grams(rows.filter("not held_out"), min(order, LOW)).toArrow().sort_by("gram")
    low = spark.sparkContext.broadcast((counted["gram"].to_numpy(), counted["n"].to_numpy()))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))).repartition(max(parts(spark), blocks), "block")

    def kept(pieces) -> DataFrame:
        """Both uses of a table of counts need all its columns and the join's null filter, so that it is made and shuffled once."""
        return dealt.mapInArrow(block_counts(pieces), "block long, w long, c long").filter("w is not null").repartition(width, "w")

    words = kept(word_pieces)
    totals = words.groupBy("w").agg(F.sum("c").alias("total"), F.max("block").alias("_b")).filter("_b >= 0").select("w", "total")
    stats = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("_words"), F.count_if(F.col("total") > 0).alias("_distinct"))
    foreign = words.join(totals, "w").filter("total <> c").select("block", "w", F.col("total").cast("double").alias("v"))

    def cost(group: pa.Table) -> pa.Table:
        found = gram_costs(group.column("w").to_numpy(), group.column("n").to_numpy(), low.value, order)
        return pa.table({"w": group.column("w"), "v": found.astype(np.float32)})

    asked = kept(gram_pieces(order))
    summed = asked.groupBy("w").agg(F.sum("c").alias("n"), F.max("block").alias("_b")).filter("_b >= 0")
    ending = F.shiftright("w", 8).bitwiseAND(F.lit((1 << 8 * min(order, LOW + 1)) - 1))
    costs = summed.select("w", "n", F.pmod(F.xxhash64(ending), F.lit(width)).alias("bucket")).groupBy("bucket").applyInArrow(cost, "w long, v float")
    back = asked.join(costs, "w").select("block", "w", F.when(F.col("c") >= 0, F.col("v").cast("double")).alias("v"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        data, offsets = arrays.text_buffers(left.column("_text"))
        held = left.column("held_out").to_numpy()
        w, v = right.column("w").to_numpy().view(np.uint64), right.column("v").to_numpy()
        gram = v < 0  # code lengths of grams; totals of words are above 0
        keys, costs_ = w[gram], v[gram].astype(np.float32)
        sort = np.argsort(keys)
        keys, costs_ = keys[sort], costs_[sort]
        w, c = w[~gram], v[~gram]
        out = np.zeros((n, 4))
        pieces, own = [], Tally()
        for i, j in arrays.chunks(offsets):
            piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            packed, row = packed_grams(piece, at, order)
            out[i:j, 3] = np.bincount(row, weights=looked_up(keys, costs_, packed, order), minlength=j - i)
            h, b = tokens(piece, at)
            row = np.repeat(np.arange(j - i), np.diff(b))
            out[i:j, 0] = np.diff(b) + 1
            pieces.append((i, j, h, row.astype(np.int32)))
            own.add(*_group(h, (~held[i:j])[row].astype(np.int64)))
        names, known = own.take()
        known[np.searchsorted(names, w)] = c
        for i, j, h, row in pieces:
            count = known[np.searchsorted(names, h)]
            out[i:j, 1] = np.bincount(row, weights=count > 0, minlength=j - i)
            out[i:j, 2] = np.bincount(row, weights=np.log10(count + 1), minlength=j - i)
        return pa.table({"_id": left.column("_id"), "held_out": left.column("held_out"), "n_tokens": out[:, 0].astype(np.int64), "_known": out[:, 1].astype(np.int64), "_logs": out[:, 2], "score": out[:, 3]})

    schema = f"_id {kind}, held_out boolean, n_tokens long, _known long, _logs double, score double"
    scored = dealt.groupBy("block").cogroup(foreign.unionByName(back).groupBy("block")).applyInArrow(score, schema)
    joined = scored.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
    total, ended = F.col("_words") + ends, F.lit(ends)
    vocabulary = F.col("_distinct") + (1 if ends else 0)
    return joined.select(
        F.col("_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("_known") + (1 if ends else 0)).alias("n_known"),
        total.alias("train_tokens"),
        (F.col("_logs") + F.log10(ended + 1.0) - F.col("n_tokens") * F.log10((total + vocabulary + 1).cast("double"))).alias("base_score"),
        "score",
    )
