"""op7's trie as a Spark table: the full order at every size, and contexts that occurred once."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import ppm


def brute(train, texts, order):
    """log10 probabilities by walking the contexts symbol by symbol; every context counts."""
    counts = defaultdict(Counter)
    prep = lambda t: [ppm.PAD] * order + list((t or "").encode()) + [ppm.END]
    for t in train:
        s = prep(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        total, s = 0.0, prep(t)
        for i in range(order, len(s)):
            excluded, p = set(), 0.0
            for k in range(order, -1, -1):
                seen = {x: n for x, n in counts[tuple(s[i - k : i])].items() if x not in excluded} if tuple(s[i - k : i]) in counts else {}
                if not seen:
                    continue
                base = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    p += math.log10(seen[s[i]] / base)
                    break
                p += math.log10(len(seen) / base)
                excluded |= set(seen)
            else:
                p -= math.log10(256 - len(excluded))
            total += p
        out.append(total)
    return out


@pytest.mark.parametrize("order,block_bytes", [(5, 1 << 20), (5, 300), (1, 300), (2, 900), (3, 900), (7, 900)])
def test_scores_against_a_walk(spark, order, block_bytes):
    rng = np.random.default_rng(5)
    words = ["the", "cat", "sat", "zürich", "mat", "a", "dog"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9))) + "".join(map(chr, rng.integers(97, 123, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "qqq|"), (62, "qqq|")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute([t for i, t in rows if not held(i)], [t for _, t in rows], order)
    got = ppm.score_documents(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), order=order, block_bytes=block_bytes).collect()
    assert any(held(i) for i, _ in rows)
    want = sorted((i, s) for (i, _), s in zip(rows, want, strict=True))
    got = sorted((r.doc_id, r.score) for r in got)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)


def test_contexts_that_occurred_once_count(spark):
    rows = [(i, f"number {i * 7919} of many") for i in range(50)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute([t for i, t in rows if not held(i)], [t for _, t in rows], ppm.ORDER)
    got = ppm.score_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert np.allclose([r.score for r in sorted(got)], want, rtol=1e-6)
