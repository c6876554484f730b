"""The forest of the n-gram join: prefixes beside brute force, the recall bound, and recall beside an exact comparison."""

from collections import Counter, defaultdict
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import arrays, ngram_join
from factloom.llm.common import table

TREES, DEPTH = 4, 2


def _keys(rng, n):
    """Signatures in which prefixes of all lengths repeat."""
    out = rng.integers(0, 3, (n, TREES, 2 + ngram_join.LONGER))
    return [[tuple(int(x) for x in tree) for tree in row] for row in out]


def _classes(spark, sigs):
    rows = []
    for i, sig in enumerate(sigs):
        flat = []
        for t, values in enumerate(sig):
            node = hash((t, values[:DEPTH])) % 2**62
            tail = 0
            for v in values[DEPTH:]:
                tail = tail << 16 | v
            flat += [node, tail]
        rows.append((bytes([i // 256, i % 256]), np.array(flat, np.int64).tobytes()))
    return spark.createDataFrame(rows, "c binary, keys binary")


def _common(a, b):
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    return n


def test_longest_shared_prefixes(spark):
    sigs = _keys(np.random.default_rng(5), 150)
    got = {(bytes(r.c), r.node): r.longer for r in ngram_join.tries(_classes(spark, sigs), TREES).collect()}
    want = {}
    for i, sig in enumerate(sigs):
        for t, values in enumerate(sig):
            best = max(_common(values, other[t]) for j, other in enumerate(sigs) if j != i)
            if best >= DEPTH:
                want[bytes([i // 256, i % 256]), hash((t, values[:DEPTH])) % 2**62] = best - DEPTH
    assert got == want and set(got.values()) == {0, 1, 2, 3}


def test_links_hold_every_asked_pair(spark):
    """Whoever shares an asked prefix ends in one family, and links never leave a shared prefix of the least depth."""
    s, recall = 0.8, 0.85
    sigs = _keys(np.random.default_rng(6), 40)
    links = {(r.u[1], r.v[1]) for r in ngram_join.trie_links(_classes(spark, sigs), s, TREES, DEPTH, recall).collect()}
    assert all(max(_common(x, y) for x, y in zip(sigs[u], sigs[v])) >= DEPTH for u, v in links)
    root = list(range(len(sigs)))
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    for i, sig in enumerate(sigs):
        lengths = [max(DEPTH, max(_common(v, o[t]) for j, o in enumerate(sigs) if j != i)) for t, v in enumerate(sig)]
        caps = [c for c in range(DEPTH, DEPTH + ngram_join.LONGER + 1) if ngram_join.missed(s, [min(c, n) for n in lengths]) <= 1 - recall]
        cap = max(caps, default=DEPTH)
        for j, other in enumerate(sigs):
            if any(_common(v, other[t]) >= min(cap, lengths[t]) for t, v in enumerate(sig)):
                assert root[i] == root[j]


def test_caps_keep_the_recall(spark):
    depth, bound = ngram_join.depth_for(0.8), 1 - ngram_join.RECALL
    rows = spark.createDataFrame([(a, b, c, d) for a in (0, 3, 20) for b in (0, 2) for c in (0, 1, 8) for d in (0, 4)], "a int, b int, c int, d int").filter("a + b + c + d <= 32")
    cap = ngram_join.cap_for([F.col(x) for x in "abcd"], 0.8, ngram_join.TREES, depth, ngram_join.RECALL)
    seen = Counter()
    for r in rows.withColumn("cap", cap).collect():
        lengths = [depth] * (32 - r.b - r.c - r.d) + [depth + 1] * r.b + [depth + 2] * r.c + [depth + 3] * r.d
        fits = [c for c in range(depth, depth + 4) if ngram_join.missed(0.8, [min(c, n) for n in lengths]) <= bound]
        assert r.cap == max(fits)
        seen[r.cap] += 1
    assert len(seen) > 1


def test_recall_beside_exact_comparison(spark):
    """All pairs at 0.8 or more of the 0.1 tables, by prefix filtering over exact sets, beside the forest's families."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    texts = docs.filter("text is not null").toPandas()
    data, offsets = arrays.text_buffers(pa.array(texts["text"]))
    values, bounds = ngram_join.shingle_sets(data, offsets)
    sets = {tuple(values[bounds[i] : bounds[i + 1]]): texts["doc_id"][i] for i in range(len(texts)) if bounds[i] < bounds[i + 1]}
    often = Counter(x for s in sets for x in s)
    seen, pairs = defaultdict(list), set()
    for s in sets:
        for x in sorted(s, key=lambda v: (often[v], v))[: len(s) - ceil(0.8 * len(s)) + 1]:
            seen[x].append(s)
    for group in seen.values():
        for a, b in combinations(group, 2):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (sets[a], sets[b]) not in pairs:
                both = len(set(a) & set(b))
                if 10 * both >= 8 * (len(a) + len(b) - both):
                    pairs.add((sets[a], sets[b]))
    family = {r.doc_id: r.class_id for r in ngram_join.join_documents(docs).select("doc_id", "class_id").collect()}
    found = sum(family[a] == family[b] for a, b in pairs)
    assert len(pairs) > 20 and found == len(pairs), (found, len(pairs))
