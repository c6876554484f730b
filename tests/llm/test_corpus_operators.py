"""Every operator against a brute-force version, on whole small tables and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import arrays, components, decontam, line_dedup, mixing, ngram_join, ppm, quality, sharding, suffix_dedup, topk, toxicity
from factloom.llm.common import table
from tests_of_operators import WORD, brute_decontam, brute_links, brute_mix, leaf_rows, lower

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, n_hit long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None, None, None, None, "a", 1),
    (2, "", "en", "src1", 0, "b", 1),
    (3, "one two", "en", "src1", 7, None, 1),
    (3, "one two", "en", "src1", 7, None, 1),
    (None, "the same words stand here again and again in this text of the day", "de", None, 5, "c", 1),
    (None, "other", None, "src2", None, "c", 2),
    (4, "the same words stand here again and again in this text of the day", "fr", "src12", 5, "d", None),
    (5, LONG, "en", "src1", len(LONG), "e", 2),
    (6, LONG + " tail", "en", "src1", len(LONG), "e", 2),
    (7, "a\nb\nc\nd\na\nb\nc\nzürich ß", "en", "src1", 9, "f", 3),
    (8, "q\na\nb\nc\nd\n\n\n\n\n", "en", "src3", 9, "f", 3),
    (9, "A-B c, D. e", "es", "src4", 9, "f", 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


# 1 sharding
@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_sharding(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = sharding.shard_documents(df, 16).collect()
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in rows) == Counter((r.doc_id, r.text_crc32, r.size) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard_documents(df.repartition(5), 16).collect()
    assert Counter(got) == Counter(again)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 225, 1000])
def test_permutation(spark, n):
    out = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 7)).collect()]
    assert sorted(out) == list(range(n))


# 2 toxicity
def test_toxicity(spark, awkward):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held)
    bad, good = [r.score for r, t in held if t], [r.score for r, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.95
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}
    odd = toxicity.score_toxicity(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
    assert toxicity.score_toxicity(awkward.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_toxicity(awkward, none).filter("predicted = 1").count() == 0


def test_filters_match_a_plain_convolution():
    rng = np.random.default_rng(1)
    ids, bounds = rng.integers(0, 50, (30, 3)), np.array([0, 0, 1, 3, 20, 30])
    tables = [[rng.normal(size=(50, 4)).astype(np.float32) for _ in range(w)] for w in (1, 2, 3)]
    bias = rng.normal(size=12).astype(np.float32)
    got, where = toxicity.pooled(ids, bounds, tables, bias, positions=True)
    for r in range(5):
        part = ids[bounds[r] : bounds[r + 1]]
        for k, per in enumerate(tables):
            best = np.zeros(4)
            for i in range(len(part)):
                best = np.maximum(best, sum(per[j][part[i + j]].sum(0) for j in range(k + 1) if i + j < len(part)) + bias[4 * k : 4 * k + 4])
            assert np.allclose(got[r, 4 * k : 4 * k + 4], best, atol=1e-5)


# 3 quality
def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality(spark, awkward):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert auc([(r.score, y) for r, y in held]) > 0.8
    alone = {r.doc_id: r.text_score for r in quality.score_quality(docs, quality.fit(docs, labels, rounds=0)).collect()}
    assert auc([(r.score, y) for r, y in held]) > auc([(alone[r.doc_id], y) for r, y in held]) - 0.02
    shuffled = quality.fit(docs.repartition(5).unionAll(docs.limit(50)), labels)
    assert np.allclose(shuffled.text.weights, model.text.weights, atol=1e-3) and np.allclose(shuffled.combine, model.combine, atol=1e-2)
    odd = quality.score_quality(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id == 3}) == 1
    assert quality.score_quality(awkward.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def test_views_hand_over_their_surest_rows(spark, docs):
    """Beside the two views over all rows on the driver: bounds, ties by key, what is left out, and a view that knows nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    columns = quality._columns(docs, "doc_id", "text", "source", "lang", "n_chars").select(F.col("_id").cast("string").alias("key"), *quality.COLUMNS)
    rows = columns.toArrow()
    x = [quality.text_view(rows["_text"]), quality.meta_view(rows["_source"], rows["_lang"], rows["_chars"])]
    views = [quality.Logit(np.zeros(a.shape[1]), np.ones(a.shape[1]), rng.normal(size=a.shape[1]), 0.1, 1.5, 0.2) for a in x]
    labelled, taken = rows["key"].to_pylist()[:40], rows["key"].to_pylist()[40:60]
    given = quality.confident(columns, spark.createDataFrame([(k,) for k in labelled], "key string"), views, taken, 7).collect()
    want = set()
    for v in (0, 1):
        z = np.round(views[v].calibrated(x[v]), 4)
        for label in (0, 1):
            open_ = [(-s if label else s, k) for s, k in zip(z, rows["key"].to_pylist()) if k not in labelled + taken and (s if label else -s) >= np.log(9)]
            want |= {(k, v, label) for _, k in sorted(open_)[:7]}
    assert {(r.key, r.view, r.label) for r in given} == want and len(given) == len(want) > 10
    none = [quality.fit_logit(a[:3], np.ones(3)) for a in x]
    assert quality.confident(columns, spark.createDataFrame([], "key string"), none, [], 7).count() == 0


def test_meta_view_of_nulls():
    import pyarrow as pa

    text, number = pa.array([None, None, "a"], pa.string()), pa.array([None, None, 3.0], pa.float64())
    got = quality.meta_view(text, text, number)
    assert (got[0] == got[1]).all() and (got[0] != got[2]).any()


# 4 mixing
@pytest.mark.parametrize("which,share,epochs", [("docs", 0.8, 2), ("docs", 1.7, 2), ("docs", 0.1, 1), ("awkward", 0.8, 2)])
def test_mixing(which, share, epochs, request):
    df = request.getfixturevalue(which)
    weights = {"broad": 3.0, "broad/en": 4.0, "niche/en/src11": 20.0}
    rows = leaf_rows(df)
    got = mixing.mix_sources(df, weights, share, epochs).collect()
    assert Counter(("\x00null" if r.doc_id is None else str(r.doc_id), r._n_tokens, r._copies) for r in got) == brute_mix(rows, weights, share, epochs)


def test_mixing_empty_and_clashing_names(awkward):
    assert mixing.mix_sources(awkward.limit(0)).count() == 0
    clash = awkward.select("*", F.lit("mine").alias("_leaf_whole"), F.lit(5).alias("_copies"), F.lit("x").alias("domain"))
    got = mixing.mix_sources(clash)
    assert got.columns == [c for c in clash.columns if c != "_copies"] + ["_domain", "_n_tokens", "_copies"] and got.filter("domain <> 'x' or _leaf_whole <> 'mine'").count() == 0
    taken = mixing.take_mix(clash)
    assert taken.columns == clash.columns and taken.count() == got.agg(F.sum("_copies")).first()[0] and taken.filter("_copies <> 5").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(awkward, {"broad": 0.0})


# 5 n-gram join
@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_ngram_join(which, request):
    df = request.getfixturevalue(which)
    got = ngram_join.join_documents(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(df.collect(), Fraction("0.8"))


def test_ngram_join_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 7] + ["new"] * (i % 2) + base[i % 7 :] + [f"t{i}"])) for i in range(40)] + [(100 + i, "alone " * (i + 1)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 2000)
    got = ngram_join.join_documents(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(df.collect(), Fraction("0.8"))
    kept = ngram_join.drop_near_copies(df).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in got if r.doc_id == r.class_id}


def test_ngram_join_empty(awkward):
    assert ngram_join.join_documents(awkward.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == r for x, r in root.items())


# 6 decontamination
@pytest.mark.parametrize("prints", [4_000_000, 0])
@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_decontamination(spark, which, prints, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(decontam, "BROADCAST_PRINTS", prints)
    items = [(None, "other"), (5, "C; d e"), (5, "again in"), (6, ""), (7, None), (8, " ".join(f"w{i % 977}x{i % 31}" for i in range(500, 530))), (80, " ".join(f"w{i % 977}x{i % 31}" for i in range(500, 530))), (81, "same words stand here again and again in this text!"), (9, "same words stand here again and again in this text"), (10, "b C d e")]
    bench = table(spark, SF, "benchmark").union(spark.createDataFrame(items, "item_id long, text string"))
    got = decontam.decontaminate(df.select("doc_id", "text", "lang"), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_decontam(df.collect(), bench.collect())


def test_decontamination_of_awkward_columns(awkward, spark):
    bench = table(spark, SF, "benchmark")
    got = decontam.decontaminate(awkward, bench.limit(0))
    assert got.filter("contaminated").count() == 0 and got.columns[:6] == [c for c in awkward.columns if c != "n_hit"]
    assert decontam.decontaminate(awkward.limit(0), bench).count() == 0
    clash = awkward.select("*", F.lit("mine").alias("t1"), F.lit(777).alias("n_words"), F.lit("x").alias("hits"))
    items = spark.createDataFrame([(1, "one TWO"), (2, "")], "item_id long, text string")
    kept = decontam.drop_contaminated(clash, items)
    assert kept.columns == clash.columns and Counter(kept.collect()) == Counter(r for r in clash.collect() if r.text != "one two")
    assert decontam.drop_contaminated(clash, items.limit(0)).count() == len(AWKWARD)


# 7 LM scoring
@pytest.mark.parametrize("which,blocks", [("docs", 32 << 20), ("docs", 20_000), ("awkward", 2000)])
def test_base_score(which, blocks, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + [None]) for r in df.collect()]
    held = lambda i: zlib.crc32((str(i) if i is not None else "\x00null").encode()) % 7 == 2
    c = Counter(t for i, ts in rows if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, ts in rows)
    got = ppm.score_documents(df, block_bytes=blocks).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_ppm_beats_the_base_on_held_out_texts(spark, docs):
    got = ppm.score_documents(table(spark, "/root/testdata/sf0.1", "documents")).filter("held_out and n_tokens > 20").collect()
    assert np.mean([r.score > r.base_score for r in got]) > 0.5
    assert ppm.score_documents(docs.limit(0)).count() == 0


# 8 top-k
@pytest.mark.parametrize("k,block,query,seeds", [(20, 8192, 8192, 4096), (3, 60, 7, 30), (1000, 100, 5, 4096), (3, 60, 7, 1)])
def test_topk(spark, k, block, query, seeds):
    df = table(spark, SF, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    odd = [(100_000, None, 1), (100_001, [1.0, None], 1), (100_002, [float("nan")] * 64, 1), (100_003, [float("inf")] * 64, 1), (100_020, [0.0] * 64, 1), (100_040, [0.1] * 64, 2), (100_041, [0.1] * 64, 2), (100_042, [0.1] * 64, 2), (None, [0.1] * 64, 1)]
    df = df.union(spark.createDataFrame(odd, df.schema))
    rows = {r.vec_id: [math.floor(64 * x) for x in r.embedding] for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = set()
    for q in rows:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:k]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    got = topk.top_k(df, lambda i: F.pmod(i, F.lit(20)) == 0, k, block_rows=block, query_rows=query, seeds=seeds).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    v = rng.integers(-5, 6, (4000, 4))
    v[17] = [60, 60, 60, 60]
    q = np.array([[9, 8, 7, 6]])
    none = np.array([np.nan])
    _, ids, scores, products = topk.threshold_search(q, np.array([-1]), none, v, np.arange(4000), 1)
    assert ids.tolist() == [17] and products == 4000
    _, ids, _, products = topk.threshold_search(q, np.array([-1]), scores.astype(float), v, np.arange(4000), 1)
    assert ids.tolist() == [17] and products < 800


def test_threshold_search_on_skewed_components():
    """Components of falling size: bounds fall below the floors of many queries, and the result stays exact."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(5000, 12)) ** 3 * 40 / np.arange(1, 13) ** 2).astype(np.int64)
    q, own = v[:200], np.arange(200)
    s = (q @ v.T).astype(float)
    s[own, own] = -np.inf
    floors = np.partition(s[:, :1200], -5, axis=1)[:, -5]
    rows, ids, scores, products = topk.threshold_search(q, own, floors, v, np.arange(5000), 5)
    want = [(i, j, s[i, j]) for i in range(200) for j in np.lexsort((np.arange(5000), -s[i]))[:5]]
    assert [(a, b, float(c)) for a, b, c in zip(rows, ids, scores)] == sorted(want, key=lambda t: (t[0], -t[2], t[1])) or sorted(zip(rows, ids, scores.astype(float))) == sorted(want)
    assert products < 0.9 * s.size


@pytest.mark.parametrize("big", [1, 2**20, 2**29])
def test_threshold_search_is_exact_for_large_components(big):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (300, 5)) * big
    rows, ids, scores, _ = topk.threshold_search(v[:9], np.arange(9), np.full(9, np.nan), v, np.arange(300), 4)
    for i in range(9):
        s = v[i] @ v.T
        best = sorted((-int(s[j]), j) for j in range(300) if j != i)[:4]
        assert sorted((-int(b), int(a)) for a, b in zip(ids[rows == i], scores[rows == i])) == sorted(best)


# 9 suffix arrays
def brute_suffix(rows, length):
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.th, (r.text or "").encode()) for r in rows})
    first, out = {}, {}
    for *key, body in order:
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - length + 1):
            w = body[s : s + length]
            if first.setdefault(w, (key, s)) != (key, s):
                gone[s : s + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        out[tuple(key)] = len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()
    return Counter((r.doc_id, *out[r.doc_id is not None, r.doc_id or 0, r.th]) for r in rows)


@pytest.mark.parametrize("which,shard,inline,hot", [("docs", 1 << 21, True, 8192), ("docs", 20_000, True, 2), ("awkward", 1 << 21, False, 8192)])
def test_suffix_dedup(which, shard, inline, hot, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    if not inline:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_PRINTS", -1)
    rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    got = suffix_dedup.remove_repeats(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows, 100)


def test_suffix_dedup_empty(awkward):
    assert suffix_dedup.remove_repeats(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("letters,n", [(2, 400), (1, 300), (4, 3000), (200, 500)])
def test_suffix_array_and_common_prefixes(letters, n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, letters, n).astype(np.uint8)
    text[n // 2 :] = np.resize(text[: n // 3], n - n // 2)
    body = text.tobytes()
    order, coarse = suffix_dedup.suffix_array(text, n + 1)
    assert order.tolist() == sorted(range(n), key=lambda i: body[i:])
    order, coarse = suffix_dedup.suffix_array(text, 20)
    lcp = suffix_dedup.common_prefixes(text, order, coarse, 20)
    for a, b, got in zip(order[:-1], order[1:], lcp[1:]):
        k = 0
        while max(a, b) + k < n and body[a + k] == body[b + k]:
            k += 1
        assert (got >= 20) == (k >= 20)
    starts = np.arange(n - 20)
    firsts = {}
    assert suffix_dedup.window_groups(text, starts, 20).tolist() == [firsts.setdefault(body[s : s + 20], s) for s in starts.tolist()]


# 10 line dedup
def brute_lines(rows, window, words):
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.th, r.text) for r in rows if r.text is not None})
    first, out = {}, {}
    for *key, text in order:
        lines, gone = text.split("\n"), set()
        for n in range(1, window + 1):
            for s in range(len(lines) - n + 1):
                w = tuple(lines[s : s + n])
                if (n == window or sum(len(x.split(" ")) for x in w) > words) and first.setdefault(w, (key, s)) != (key, s):
                    gone |= set(range(s, s + n))
        out[tuple(key)] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(i - 1 not in gone for i in gone)
    return Counter((r.doc_id, *(out[r.doc_id is not None, r.doc_id or 0, r.th] if r.text is not None else (None, 0, 0, 0))) for r in rows)


@pytest.mark.parametrize("which,window,words,small", [("docs", 3, 50, True), ("docs", 2, 9, False), ("awkward", 3, 50, True), ("awkward", 3, 3, False)])
def test_line_dedup(which, window, words, small, request, monkeypatch):
    df = request.getfixturevalue(which)
    if not small:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    got = line_dedup.dedup_lines(df, window, words).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_removed, r.n_runs) for r in got) == brute_lines(rows, window, words)
    assert line_dedup.dedup_lines(df.limit(0), window).count() == 0


def test_line_dedup_of_clashing_names_and_hot_lines(spark):
    rows = [(i, f"a\nb\nc\n{i}", 5, i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, _t int, _removed string")
    got = line_dedup.dedup_lines(df).collect()
    assert {(r.doc_id, r.kept_text, r.n_removed, r._t, r._removed) for r in got} == {(i, str(i) if i else "a\nb\nc\n0", 3 if i else 0, i, "x") for i in range(300)}


def test_line_dedup_of_very_long_texts(spark):
    import time

    took = []
    for n in (20_000, 20_000, 40_000):
        began = time.time()
        df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n)))], "doc_id long, text string")
        assert line_dedup.dedup_lines(df).first().n_lines == n
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 2


def test_suffix_dedup_clashing_names(spark):
    """Columns of the operator's own names stay, repeated ids are told apart by their texts, and null ids come first."""
    long = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(3))[:140]
    rows = [(2, "x" + long, 1, "a"), (1, long, 2, "b"), (1, "other" * 3, 3, "c"), (None, long[:120], 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _i int, _lo string").withColumn("_t", F.lit(1)).withColumn("id", F.lit("q")).withColumn("_stop", F.lit(2)).withColumn("__t", F.lit(3))
    got = {(r["doc_id"], r["_lo"]): r for r in suffix_dedup.remove_repeats(df).collect()}
    assert {k: (r["n_removed"], r["_i"], r["id"], r["__t"]) for k, r in got.items()} == {(2, "a"): (140, 1, "q", 3), (1, "b"): (120, 2, "q", 3), (1, "c"): (0, 3, "q", 3), (None, "d"): (0, 4, "q", 3)}
