"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a ``length``-byte string over it also starts earlier (smaller id, or same document and earlier start).

1. Fingerprints. Every window of ``length`` bytes selects its ``GRAM``-byte string of smallest hash, so equal windows
   select equal strings at one distance; consecutive windows with one selected string make a stretch. Only stretches whose
   selected string occurs twice anywhere can hold repeats (counted by hash, 4 bytes each).
2. Whole stretches. Equal stretches hold equal windows, so all but a stretch's first place go at once.
3. Suffix arrays. First places of different stretches may still share some windows; then they share the selected string
   with ``side`` bytes to its left or to its right. Their bytes are dealt into shards by these halves. Each shard's suffix
   array is built by Larsson-Sadakane refinement (prefix doubling on the groups that are not sorted yet), and Kasai's rule
   (a suffix's common prefix with its predecessor is at most one shorter than that of the suffix one byte before) bounds
   the groups of equal windows. All but the first place of a group go.
4. Merging. A half that very many stretches share is dealt into several shards; these send the first place of each of
   their windows, in hash order, to merge tasks, which find every window's stretch of places by binary search, and all
   but the earliest go.

Hot strings stay cheap: step 2 sees a minimum, and a shard sends a window once, however often it holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, cut, parts, small, stored

LENGTH = 100
GRAM = 24
SHARD_BYTES = 1 << 21
HOT_STRETCHES = 8192  # stretches with one half in a shard at most, but for chance
BROADCAST_PRINTS = 8_000_000  # repeated fingerprints (4 bytes each) that are broadcast at most; beyond, a shuffled join
_CODE2 = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(selected hash, stretch hash, first start, last start, left half, right half, selected place) by stretch.

    The halves are hashes of the selected string with the ``side`` bytes before or after it (0 where a row ends sooner):
    a window reaches at least that far to one side, so stretches that share a window share a half.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint32, np.uint64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    found = []
    side = (length - gram) // 2
    step = arrays.CHUNK_BYTES
    size = np.diff(offsets)
    mark = np.zeros(len(data) + 1, np.int8)
    big = size >= length
    mark[offsets[:-1][big]] += 1
    mark[offsets[1:][big] - length + 1] -= 1
    valid_all = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    for a in range(0, max(0, len(data) - length + 1), step):
        piece = data[a : a + step + length - 1]
        n = len(piece) - length + 1
        valid = valid_all[a : a + n]
        if not valid.any():
            continue
        sums = arrays.prefix_sums(piece)
        m = len(piece) - gram + 1
        g = arrays.mix((sums[gram:] - sums[:-gram]) * arrays.powers(len(sums))[1][:m])
        low = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        owner = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
        lo = np.flatnonzero(new & valid)
        last = np.ones(n, bool)
        last[:-1] = (owner[1:] != owner[:-1]) | ~valid[1:]
        hi = np.flatnonzero(last & valid)
        own = owner[lo]
        c = arrays.mix(arrays.stretch_hashes(sums, lo, hi + length) + ((own - lo) * 4096 + (hi - lo)).astype(np.uint64))
        left, right = np.maximum(own - side, 0), np.minimum(own + gram + side, len(piece))
        halves = [arrays.stretch_hashes(sums, left, own + gram), arrays.stretch_hashes(sums, own, right) ^ np.uint64(1)]
        row = np.searchsorted(offsets, own + a, "right") - 1
        halves[0][own + a - side < offsets[row]] = 0
        halves[1][own + a + gram + side > offsets[row + 1]] = 0
        found.append(((g[own] >> np.uint64(13)).astype(np.uint32), c, lo + a, hi + a, *halves, own + a))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(7)) if found else none


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group starts) of a shard, in the order of ``depth`` bytes at least.

    The groups are those of the last round whose h was below ``depth``: suffixes with ``depth`` bytes in common are in one.

    Larsson-Sadakane: ranks are first group numbers by a packed prefix; each round sorts only the members of groups of two
    and more by the rank ``h`` bytes on, and doubles h.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    index_bits = max(1, int(n).bit_length())
    used, symbol = np.unique(text, return_inverse=True)
    bits = max(1, int(len(used)).bit_length())
    h = max(1, (63 - index_bits) // bits)
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = symbol + 1
    packed = np.zeros(n, np.uint64)
    for k in range(h):
        packed = (packed << np.uint64(bits)) | padded[k : k + n]
    low = np.uint64(index_bits)
    packed = np.sort((packed << low) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << index_bits) - 1)).astype(np.int64)
    key = packed >> low
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    coarse = np.zeros(n, bool)
    coarse[0] = True
    while h < depth:
        coarse = edge.copy()
        alone = edge & np.concatenate([edge[1:], [True]])
        at = np.flatnonzero(~alone)  # places in groups of two and more
        if not len(at):
            break
        member = order[at]
        follow = np.where(member + h < n, rank[np.minimum(member + h, n - 1)] + 1, 0)
        if index_bits * 2 + 1 + int(len(at)).bit_length() <= 64:
            packed = np.sort((((start[at].astype(np.uint64) << np.uint64(index_bits + 1)) | follow.astype(np.uint64)) << np.uint64(int(len(at)).bit_length())) | np.arange(len(at), dtype=np.uint64))
            by = (packed & np.uint64((1 << int(len(at)).bit_length()) - 1)).astype(np.int64)
        else:
            by = np.lexsort((follow, start[at]))
        member, follow, group = member[by], follow[by], start[at][by]
        order[at] = member
        edge[at] = np.concatenate([[True], (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])])
        start = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
        rank[order[at]] = start[at]
        h *= 2
    return order, coarse


def common_prefixes(text: np.ndarray, order: np.ndarray, coarse: np.ndarray, limit: int) -> np.ndarray:
    """By place in ``order``: bytes shared with the suffix before it, exact up to ``limit``; 0 where a group starts.

    Kasai's rule, vectorised: a suffix whose predecessor directly follows that of the suffix one byte before has one byte
    less in common, so only the first suffix of such a run is compared, eight bytes at a time.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(~coarse)
    if not len(at):
        return lcp
    before = np.full(n, -1)
    before[order[at]] = order[at - 1]
    here = np.flatnonzero(before >= 0)
    head = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (before[here[1:]] != before[here[:-1]] + 1)])
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)]).astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + n + 8] << np.uint64(8 * k)
    first = here[head]
    run = np.diff(np.append(np.flatnonzero(head), len(here)))
    a, b, got, most = first.copy(), before[first], np.zeros(len(first), np.int64), limit + run
    live = np.arange(len(first))
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        inside = (x < n) & (y < n)
        diff = np.where(inside, words[np.minimum(x, n)] ^ words[np.minimum(y, n)], 1)
        same = np.full(len(live), 8)
        bad = diff != 0
        lowest = diff[bad] & (~diff[bad] + np.uint64(1))
        same[bad] = (np.log2(lowest.astype(np.float64)) // 8).astype(np.int64)
        same = np.where(inside, np.minimum(same, n - np.maximum(x, y)), 0)
        got[live] += same
        live = live[(same == 8) & (got[live] < most[live])]
    part = np.repeat(np.arange(len(first)), run)
    lcp[rank_place(order, here)] = np.maximum(got[part] - (here - first[part]), 0)
    return lcp


def rank_place(order: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Places of ``members`` in ``order``."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[members]


def window_groups(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the ascending ``starts``, the smallest start in the shard with the same ``length`` bytes."""
    order, coarse = suffix_array(text, length)
    lcp = common_prefixes(text, order, coarse, length)
    group = np.cumsum(lcp < length)
    of = np.empty(len(text), np.int64)
    of[order] = group
    mine = of[starts]
    first = np.full(int(group[-1]) + 1 if len(group) else 1, len(text))
    np.minimum.at(first, mine, starts)
    return first[mine]


def _among(sorted_keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Which probes occur in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(probe), bool)
    at = np.searchsorted(sorted_keys, probe)
    return sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == probe


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether any id occurs twice."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def _key(ids: list) -> np.ndarray:
    """Order numbers of ids, nulls first."""
    rank = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}))}
    return np.array([-1 if x is None else rank[x] for x in ids], np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_bytes (the remaining bytes), n_bytes, n_removed, n_spans and kept_sha256.

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows are ordered by id (null first)
    and, where ids repeat, by a 64-bit text hash; rows that repeat both are one document. Input columns with the names of the
    new ones are replaced, those with names of the operator's own columns stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    batched(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    new = ["kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own_columns = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(text_col), F.lit(""))
    doubled = _repeats(docs, id_col)
    told_apart = F.xxhash64(text) if doubled else F.lit(0).cast("long")  # where ids are unique, they name documents
    source = docs.select(F.col(id_col).alias("id"), told_apart.alias("th"), text.alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("text"))
            for i, j in arrays.chunks(offsets, SHARD_BYTES):
                g = np.sort(stretches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)[0].view(np.int32))
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(g))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(many.astype(np.int8) + np.int8(1))], ["g", "n"])

    counted = source.select("text").mapInArrow(prints, "g int, n byte").groupBy("g").agg(F.sum("n").alias("n"))
    repeated = cut(counted.filter("n > 1").select("g"))
    inline = repeated.count() <= BROADCAST_PRINTS
    known = spark.sparkContext.broadcast(np.sort(repeated.toArrow()["g"].to_numpy())) if inline else None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("text"))
            for i, j in arrays.chunks(offsets, SHARD_BYTES):
                at = offsets[i : j + 1] - offsets[i]
                g, c, lo, hi, left, right, place_ = stretches(data[offsets[i] : offsets[j]], at, length)
                if known is not None:
                    mine = _among(known.value, g.view(np.int32))
                    g, c, lo, hi, left, right, place_ = (x[mine] for x in (g, c, lo, hi, left, right, place_))
                row = np.searchsorted(at, lo, "right") - 1
                who = pa.array(row + i)
                base = at[row]
                ends = [pa.array((x - base).astype(np.int32)) for x in (lo, hi, place_)]
                longs = [pa.array(x.view(np.int64)) for x in (c, left, right)]
                cols = [b.column("id").take(who), b.column("th").take(who), longs[0], *ends, *longs[1:], pa.array(g.view(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "th", "c", "lo", "hi", "own", "l", "r", "g"])

    hits = source.mapInArrow(places, f"id {kind}, th long, c long, lo int, hi int, own int, l long, r long, g int")
    hits = stored(hits.drop("g") if inline else hits.join(repeated, "g", "left_semi").drop("g"))
    place = F.struct("id", "th", "lo")
    firsts = hits.groupBy("c").agg(F.min(F.struct("id", "th", "lo", "hi", "own", "l", "r")).alias("f"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.select("c", "f.*", (F.col("n") > 1).alias("more")))
    earliest = firsts.filter("more").select("c", place.alias("f"))
    later = hits.select("c", "id", "th", "lo", "hi").join(earliest, "c").filter(~place.eqNullSafe(F.col("f")))
    whole = later.select("id", "th", "lo", (F.col("hi") + length).alias("stop"))

    halves = firsts.select("id", "th", "lo", "hi", "own", F.explode(F.array(F.struct(F.col("l").alias("k"), F.lit(True).alias("left")), F.struct(F.col("r").alias("k"), F.lit(False).alias("left")))).alias("h"))
    halves = halves.select("id", "th", "lo", "hi", "own", "h.k", "h.left").filter("k <> 0")
    often = halves.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("salts", F.ceil(F.col("n") / HOT_STRETCHES).cast("int"))
    spread = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "th", "lo"), F.col("salts"))).otherwise(0).cast("int")
    dealt = halves.join(often.select("k", "salts"), "k").withColumn("salt", F.when(F.col("salts") > 1, spread).otherwise(-1))
    wanted = stored(dealt.groupBy("id", "th").agg(F.collect_list(F.struct("k", "left", "salt", "lo", "hi", "own")).alias("spans")))
    texts = source.join(small(wanted.select(F.col("id").alias("_i"), F.col("th").alias("_t"))), F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left_semi")
    texts = texts.dropDuplicates(["id", "th"]) if doubled else texts
    texts = texts.join(wanted.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "spans"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")))
    texts = texts.select("id", "th", "text", *[F.col(f"spans.{c}").alias(c) for c in ("k", "left", "salt", "lo", "hi", "own")])
    side = (length - GRAM) // 2

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each stretch's windows on one side of its half, with their first and last start."""
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("text"))
            size = np.diff(b.column("k").offsets.to_numpy())
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "left", "salt", "lo", "hi", "own")}
            row = np.repeat(np.arange(b.num_rows), size)
            at = offsets[row] + flat["lo"]
            # The windows that reach ``side`` bytes or more to the left of the selected string end ``side`` after it.
            edge = offsets[row] + flat["own"] - side
            lo = np.where(flat["left"], at, np.maximum(at, edge + 1))
            hi = np.where(flat["left"], np.minimum(offsets[row] + flat["hi"], edge), offsets[row] + flat["hi"])
            ok = np.flatnonzero(lo <= hi)
            body = pa.array([data[x:y].tobytes() for x, y in zip(lo[ok].tolist(), (hi[ok] + length).tolist(), strict=True)], pa.binary())
            take = pa.array(row[ok])
            cols = [pa.array(flat["k"][ok]), pa.array(flat["salt"][ok].astype(np.int32)), b.column("id").take(take), b.column("th").take(take), pa.array((lo - offsets[row])[ok].astype(np.int32)), body]
            yield pa.RecordBatch.from_arrays(cols, ["k", "salt", "id", "th", "lo", "body"])

    pieces = texts.mapInArrow(contexts, f"k long, salt int, id {kind}, th long, lo int, body binary")
    pieces = pieces.repartition(parts(spark), "k", "salt").sortWithinPartitions("k", "salt", "id", "th", "lo")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of one half and salt, as many as fit a shard."""
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                held.append(part)
                size += part.column("body").nbytes
                if size >= SHARD_BYTES:
                    table = pa.Table.from_batches(held).combine_chunks()
                    k, salt = table["k"].to_numpy(), table["salt"].to_numpy()
                    change = np.flatnonzero((k[1:] != k[:-1]) | (salt[1:] != salt[:-1]))
                    if len(change):
                        end = int(change[-1]) + 1
                        yield from shard(table.slice(0, end))
                        held = table.slice(end).to_batches()
                        size = sum(x.column("body").nbytes for x in held)
        if held:
            yield from shard(pa.Table.from_batches(held))

    def shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        order = pa.array(np.lexsort((table["lo"].to_numpy(), table["th"].to_numpy(), _key(table["id"].to_pylist()))))
        table = table.take(order).combine_chunks()
        bodies = table["body"].chunk(0)
        at = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        text_ = np.frombuffer(bodies.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        span = np.repeat(np.arange(len(bodies)), np.diff(at))
        rel = np.arange(len(text_)) - at[span]
        starts = np.flatnonzero(rel <= (np.diff(at) - length)[span])
        first = window_groups(text_, starts, length)
        who, where = span[starts], table["lo"].to_numpy()[span[starts]] + rel[starts]
        repeat = first != starts
        hot = np.flatnonzero(~repeat & (table["salt"].to_numpy()[who] >= 0))
        gone = np.flatnonzero(repeat)
        lead = np.concatenate([[True], (who[gone][1:] != who[gone][:-1]) | (where[gone][1:] != where[gone][:-1] + 1)]) if len(gone) else np.zeros(0, bool)
        last = np.concatenate([lead[1:], [True]]) if len(gone) else lead
        one, two = arrays.prefix_sums(text_), arrays.prefix_sums(text_, _CODE2)
        s = starts[hot]
        w1, w2 = arrays.stretch_hashes(one, s, s + length), arrays.stretch_hashes(two, s, s + length)
        rows = np.concatenate([who[gone[lead]], who[hot]])
        lo = np.concatenate([where[gone[lead]], where[hot]])
        stop = np.concatenate([where[gone[last]], where[hot]]) + length
        done = np.concatenate([np.ones(lead.sum(), bool), np.zeros(len(hot), bool)])
        keys = [pa.array(np.concatenate([rows[: lead.sum()] * 7919, w.view(np.int64)])) for w in (w1, w2)]
        take = pa.array(rows)
        cols = [table["id"].chunk(0).take(take), table["th"].chunk(0).take(take), pa.array(lo.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(done), *keys]
        yield pa.RecordBatch.from_arrays(cols, ["id", "th", "lo", "stop", "done", "w1", "w2"])

    windows = pieces.mapInArrow(shards, f"id {kind}, th long, lo int, stop int, done boolean, w1 long, w2 long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeats that shards found pass; of each window's sorted places all but the first become repeats."""
        last = None
        for b in batches:
            w1, w2, done = b.column("w1").to_numpy(), b.column("w2").to_numpy(), b.column("done").to_numpy(zero_copy_only=False)
            if not len(w1):
                continue
            open_ = np.flatnonzero(~done)  # sorted by w1, w2 and place
            a, c = w1[open_], w2[open_]
            repeat = np.arange(len(a)) > np.searchsorted(a, a, "left")
            if len(a):
                repeat[1:] &= c[1:] == c[:-1]
                repeat[0] = last == (a[0], c[0])
                last = (a[-1], c[-1])
            take = pa.array(np.concatenate([np.flatnonzero(done), open_[repeat]]))
            yield pa.RecordBatch.from_arrays([b.column(x).take(take) for x in ("id", "th", "lo", "stop")], ["id", "th", "lo", "stop"])

    merged = windows.repartition(parts(spark), "w1", "w2").sortWithinPartitions("done", "w1", "w2", "id", "th", "lo")
    across = merged.select("id", "th", "lo", "stop", "done", "w1", "w2").mapInArrow(merge, f"id {kind}, th long, lo int, stop int")
    gone = whole.unionAll(across).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "stop")).alias("_cuts"))
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    key, print_, los_, stops_ = (mark + c for c in ("i", "t", "lo", "stop"))
    gone = gone.select(F.col("id").alias(key), F.col("th").alias(print_), F.transform("_cuts", lambda x: x["lo"]).alias(los_), F.transform("_cuts", lambda x: x["stop"]).alias(stops_))
    rows = docs.select(*[F.col(f"`{c}`") for c in own_columns]).join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (told_apart == F.col(print_)), "left").drop(key, print_)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column(text_col))
            los, stops = b.column(los_), b.column(stops_)
            kept, out = [], np.zeros((b.num_rows, 3), np.int64)
            for r in range(b.num_rows):
                body = data[offsets[r] : offsets[r + 1]]
                out[r, 0] = len(body)
                if los[r].is_valid:
                    edge = np.zeros(len(body) + 1, np.int64)
                    np.add.at(edge, los[r].values.to_numpy(), 1)
                    np.add.at(edge, stops[r].values.to_numpy(), -1)
                    bad = np.cumsum(edge[:-1]) > 0
                    out[r, 1], out[r, 2] = bad.sum(), bad[0] + (bad[1:] & ~bad[:-1]).sum()
                    body = body[~bad]
                kept.append(body.tobytes())
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            cols = [b.column(c) for c in own_columns] + [pa.array(kept, pa.binary()), *[pa.array(out[:, k]) for k in range(3)], sha]
            yield pa.RecordBatch.from_arrays(cols, own_columns + new)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own_columns)
    return rows.mapInArrow(finish, f"{base}, kept_bytes binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
