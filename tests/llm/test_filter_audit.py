"""The audit beside a plain walk through every order, and the cases of the docstring."""

import itertools
import re
from collections import defaultdict

from factloom.llm import filter_audit
from factloom.llm.filter_audit import audit_filters, failed_filters, repeated_ids

SCHEMA = "doc_id long, text string, lang string, mask int"
LONG = " ".join(f"w{i}" for i in range(120))


def _docs():
    texts = [LONG, LONG + " $", "a b a b a b", "ABC DEF", "", None, LONG.upper(), "x " * 150, "tab\x0bbed|words", LONG, LONG, "a b a b a b"]
    rows = [(i, t, ["en", "de", None, ""][i % 4], 7) for i, t in enumerate(texts * 5)]
    return rows + [(None, LONG, "en", 7), (3, "ABC DEF", "en", 7), (3, "ABC DEF", "en", 7), (0, LONG, "de", 7)]


LABELS = [(i, i % 2, i % 3 % 2) for i in range(50)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]


def _brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    masks = defaultdict(list)
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, f in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)))) if f}
        if i is not None and first[t] < i:
            fails.add("E")
        masks[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = [], defaultdict(int)
    for part, docs in masks.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                shapley[part, c] += len(gone)
                failing = sum(c in d[0] for d in docs)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {c} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), c))
    return sorted((*r[:9], shapley[r[0], r[9]]) for r in out)


def test_beside_brute_force(spark):
    docs = spark.createDataFrame(_docs(), SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit_filters(docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == _brute(_docs(), LABELS)
    assert got.count() == 600 * 3


def test_chains_of_one_fingerprint(spark):
    """Different texts of one fingerprint stay apart, and the smallest id wins in any order of arrival."""
    chains = filter_audit._Chains()
    lost = [x for row in [(1, "a", 5), (1, "b", 4), (1, "a", 2), (1, "b", 9), (1, "a", 2), (1, "a", 7)] for x in chains.meet(row[0], row[1], row[2], {"": 1}, 0)]
    assert [(x[0], x[3]) for x in lost] == [(5, 1), (9, 1), (7, 1)]
    assert sorted((t, i, r[""]) for _, t, i, r, _ in chains.entries()) == [("a", 2, 2), ("b", 4, 1)]


def test_small_local_chains_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(_docs(), SCHEMA).coalesce(1)
    whole = sorted(map(tuple, failed_filters(docs).collect()), key=repr)
    real = filter_audit._send

    def little(rows):
        filter_audit.LOCAL_BYTES = 500
        return real(rows)

    monkeypatch.setattr(filter_audit, "_send", little)
    flat = lambda rows: sorted(((i, p, m) for i, p, m, n in rows for _ in range(n)), key=repr)
    assert flat(map(tuple, failed_filters(docs).collect())) == flat(whole)


def test_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x"), ("c", "x"), (None, "x"), ("a", "y")], "k string, body string")
    assert sorted(r[0] for r in repeated_ids(docs, "k", "body").collect()) == ["b", "c", "c"]


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert audit_filters(spark.createDataFrame([(1, None, None, 0)], SCHEMA), labels).count() == 600
