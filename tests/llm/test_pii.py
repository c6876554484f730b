"""Base spans beside Python's own patterns, boosting beside its loss, added spans on planted texts, and the cases."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and _luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def _base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _passes(k, m.group())]


def _card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if _luhn(head + c))


def _texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "é", "😀", " ", "-", ".", "..", "@", "+", "1", "25", "255", "256", "0010", "(", ")", "x@y.z", "a.b@c-d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "+1 (132) 555-1352", "_", "%", "\n", "4111111111111111", "4111 1111-1111 1111", "00000000000000000000"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(n)]


LONG = ["1" * 30000, "a" * 30000 + "@", "1 " * 20000, "+1 " * 9000, "1." * 9000, "a@b" + ".c" * 9000, "x@y.zz " * 4000 + "1.1.1.1"]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans(spark):
    texts = [None, "", "a@b.com_x@y.org", "a@b.com.c@d.e", "9.9.9.999 1.1.1.1", "😀 1.2.3.4"] + _texts(1, 600) + LONG
    got = {r["doc_id"]: r for r in pii.find_pii(_frame(spark, texts), pii.Model()).collect()}
    for i, t in enumerate(texts):
        want = _base(t)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (got[i]["spans"], got[i]["n_added"]) == (named, 0), t[:200]
        assert got[i]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]


def _planted(seed=7, n=300):
    rng = random.Random(seed)
    quad = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    word = lambda: rng.choice(["ein", "the", "son", "über", "and"])
    rows = []
    for _ in range(n):
        some = [f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", quad(), _card(rng), phone(), str(rng.randrange(10**15, 10**16)), f"{rng.randrange(300, 999)}.1.2.3"]
        rng.shuffle(some)
        rows.append(" ".join(x for s in some for x in (word(), s, word())))
    return rows, phone, rng


def test_added_spans(spark):
    """Spans that the base patterns lose in longer chains are found; clean texts, wrong check digits and long numbers are left."""
    rows, phone, rng = _planted()
    card = _card(rng)
    bad = card[:-1] + str((int(card[-1]) + 5) % 10)
    p = phone()
    cases = [f"x {p} {card} y", f"x {p} {bad} y", "the version 3.4.500.6 of 2024-01-02 and 12 345", f"id {'7' * 40} end", f"x {card} {card[::-1]}"]
    docs = _frame(spark, rows + cases)
    model = pii.fit(docs)
    got = {r["doc_id"] - len(rows): r for r in pii.find_pii(docs, model).filter(F.col("doc_id") >= len(rows)).collect()}
    assert got[0]["spans"] == f"card:{3 + len(p)}:{3 + len(p) + 16},phone:2:{2 + len(p)}" and got[0]["n_added"] == 2
    assert got[1]["spans"] == f"phone:2:{2 + len(p)}"
    assert got[2]["n_added"] == got[3]["n_added"] == 0
    assert "card:2:18" in got[4]["spans"]
    base = pii.find_pii(docs, pii.Model()).collect()
    every = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.find_pii(docs, model).collect()}
    assert all(set(r["spans"].split(",")) - {""} <= every[r["doc_id"]] for r in base)


def test_written_out_addresses(spark):
    rows, *_ = _planted(9)
    docs = _frame(spark, rows + ["mail john.doe [at] example [dot] com now", "10[.]0[.]0[.]7 answers", "we met at the dot of noon"])
    got = {r["doc_id"] - len(rows): r for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    assert got[0]["spans"] == "email:5:36" and got[1]["spans"] == "ip:0:14"


def test_proposals_overlap(spark):
    """Every place where a pattern matches is proposed, also within another match; positions are the places'."""
    texts = ["1234 4111 1111 1111 1111 22", "😀4111-1111-1111-1111", "", "1.2.3.4.5.6"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for kind, g in (("card", 1), ("card", 2), ("ip", 0)):
        got = {r["i"]: [(m["start"], m["end"]) for m in r["m"]] for r in df.select("i", pii._proposals(F.col("t"), pii.GENERATORS[kind][g], pii.GATES[kind][g]).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.start() + len(m.group(1))) for m in re.finditer(f"(?=({pii.GENERATORS[kind][g]}))".replace(r"\1", r"\2"), t)]


def test_trees_as_columns(spark):
    """The CASE expression gives the score of the walk down the trees, and boosting lowers the loss below the constant's."""
    rng = random.Random(2)
    counts = {}
    for _ in range(60):
        v = tuple(rng.randrange(5) for _ in pii.FEATURES)
        counts[v] = [rng.randrange(20), rng.randrange(40) if v[1] > 2 else rng.randrange(3)]
    constant, trees = pii.boost(counts)
    model = pii.Model({"card": constant}, {"card": trees}, {"card": 0.5})
    flat = pii.Model({"card": constant}, {"card": []})
    loss = lambda m: -sum(p * math.log(m.score("card", v)) + u * math.log(1 - m.score("card", v)) for v, (u, p) in counts.items())
    assert loss(model) < 0.7 * loss(flat)
    df = spark.createDataFrame([(v,) for v in counts], "f struct<" + ",".join(f"{n}:int" for n in pii.FEATURES) + ">")
    for r in df.select("f", model.column("card", F.col("f")).alias("s")).collect():
        assert math.isclose(r["s"], model.score("card", tuple(r["f"])), rel_tol=1e-9)


def test_calibration():
    model = pii.Model({"ip": 0.0}, {"ip": [(1, 0, -2.0, 2.0)]})
    good, bad = (0, 1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0)
    assert pii.calibrate(model, "ip", {good: [5, 95], bad: [90, 10]}) == model.score("ip", good)
    assert pii.calibrate(model, "ip", {good: [50, 50]}) > 1
    assert pii.calibrate(model, "ip", {}) > 1


def test_cases(spark):
    docs = spark.createDataFrame([(None, "a@b.c", 1, "q"), (5, None, 1, "q"), (5, "1.1.1.1", 1, "q"), (5, "1.1.1.1", 1, "q")], "doc_id long, text string, email int, _text string")
    got = pii.find_pii(docs, pii.fit(docs))
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in got.collect()) == [(0, "email:0:5"), (5, ""), (5, "ip:0:7"), (5, "ip:0:7")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0


@pytest.mark.parametrize("m", [0, 1, 2, 3, 10, 101])
def test_offsets(spark, m):
    steps = [i * i % 7 for i in range(m)]
    df = spark.createDataFrame([(steps,)], "s array<long>")
    got = df.select(pii._offsets(F.col("s"))(lambda at: F.transform("s", lambda _, i: at(i))).alias("o")).first()[0]
    assert got == [sum(steps[:i]) for i in range(m)]
