"""op2's thresholds: the best F1 over all labelled rows outside the held-out fold, whatever the training sample's balance."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import toxicity
from factloom.llm.common import table

SF = "/root/testdata/sf0.1"


def f1(z, y, cut):
    hit = z >= cut
    return 2 * (hit & y).sum() / max(hit.sum() + y.sum(), 1)


@pytest.mark.parametrize("max_rows", [200, 600])
def test_thresholds_cover_all_labelled_rows(spark, max_rows):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels, max_rows=max_rows)
    marked = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = [(r.text, marked[r.doc_id]) for r in docs.select("doc_id", "text").collect() if r.doc_id in marked]
    col, y = pa.array([t for t, _ in rows]), np.array([k > 0 for _, k in rows])
    shown = toxicity.score_batch(model, col) >= toxicity.THRESHOLD
    ids = [toxicity.features(*toxicity.arrays.text_buffers(pa.array([t]))) for t, _ in rows]
    lang = np.array([toxicity.languages(h, b)[0] for _, h, b in ids])
    z = np.array([(toxicity.pooled(i, b, model.tables, model.bias)[0].astype(float) @ model.weights.astype(float))[0] + model.intercept for i, _, b in ids])
    assert (shown == (z >= model.thresholds[lang])).all()
    for c in range(len(toxicity.FUNCTION_WORDS)):
        mine = lang == c
        best = max(f1(z[mine], y[mine], cut) for cut in np.unique(z[mine]))
        assert y[mine].sum() > 5 and f1(z[mine], y[mine], model.thresholds[c]) > best - 0.03, (c, best, f1(z[mine], y[mine], model.thresholds[c]))


def test_binned_threshold_weighs_the_labels():
    clean, toxic = np.zeros(toxicity.BINS), np.zeros(toxicity.BINS)
    at = lambda x: toxicity.BINS // 2 + int(x / toxicity.BIN)
    clean[at(-1)], clean[at(1)], toxic[at(1)], toxic[at(2)] = 90, 10, 10, 20
    assert 0 > toxicity.binned_threshold(clean, toxic, (1, 1), 9.0) - 1 and toxicity.binned_threshold(clean, toxic, (20, 1), 9.0) > 1
    assert toxicity.binned_threshold(clean, toxic * 0, (1, 1), 9.0) == 9.0
