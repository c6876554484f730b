"""Personal data by candidate gradient boosting (DataFrame functions only).

Base patterns give sure spans. High-recall generators then propose overlapping spans of the same kinds at every place where
one may start: numbers inside longer chains, phones without a plus sign, addresses written out. They run over the text with
the sure spans blanked out, and over the sure spans themselves, also rewritten the way each generator reads them. The latter
are positive examples, the former unlabelled ones; a feature vector (generator, check digits, length, separators, neighbours,
words before) has few values, so one aggregate counts both kinds of examples for every vector over all documents. Boosted
trees are fitted to these counts, thresholds are calibrated on a fold of their own, and trees and thresholds become one CASE
expression that every task evaluates on its own rows: scoring shuffles nothing.

Positions come from the lengths of the pieces between matches, summed in blocks, so a text of m matches costs m * sqrt(m).
Patterns are possessive and start at a run's first character, so long runs cost linear time and no stack.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_fold

KINDS = ("email", "ip", "card", "phone")

#: What the base patterns match, written so that a run of characters is tried once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Proposals by kind: each pattern is tried at every place, so proposals overlap.
GENERATORS = {
    "email": [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:@|at|AT) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?(?:\.|dot|DOT) ?[\])}]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ (?:at|AT|@) [A-Za-z0-9-]{1,63}+(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}+){1,8}+",
    ],
    "ip": [
        r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{16,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}(?![0-9])",
    ],
    "phone": [
        r"\+[0-9]{1,3}+[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"\+[0-9]{1,3}+(?:[ .-][0-9]{2,4}){3}(?![0-9])",
        r"(?<![0-9+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![0-9+(])00[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    ],
}

#: How a sure span is rewritten to be an example for the generator of the same place in GENERATORS (pattern, replacement).
REWRITES = {
    "email": [[("@", " [at] ")], [("@", " at "), (r"\.(?=[^@]*$)", " dot ")]],
    "ip": [[], [(r"\.", "[.]")]],
    "card": [[("[^0-9]", "")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1-")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1-")]],
    "phone": [[], [("[() ]+", " ")], [(r"^\+[0-9]+ ", "")], [(r"^\+", "00")]],
}

#: Words before a span that speak for its kind, in lower case.
CUES = {"email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|address|addr", "card": "card|visa|pay|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|handy|móvil"}

FEATURES = ("gen", "ok", "digits", "mixed", "before", "after", "cue")
WINDOW = 32  # characters before a span in which a cue counts
FOLDS = 4  # one of them calibrates
TREES, DEPTH, RATE = 20, 3, 0.3
PRECISION = 0.9


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: a lambda's argument, which the optimizer cannot write out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _offsets(steps: Column) -> Callable[[Callable[[Callable[[Column], Column]], Column]], Column]:
    """with_offsets(f): f gets at(i), the sum of steps[0..i), from sums of blocks of about sqrt(m) steps."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def run(use: Callable[[Callable[[Column], Column]], Column]) -> Column:
        def with_width(s: Column) -> Column:
            width = s["width"]
            blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(s["steps"]) - 1) / width, F.lit(0)).cast("int")), lambda b: total(F.slice(s["steps"], b * width + 1, width)))

            def with_blocks(bs: Column) -> Column:
                at = lambda i: total(F.slice(bs, F.lit(1), F.floor(i / width).cast("int"))) + total(F.slice(s["steps"], (i - F.pmod(i, width) + 1).cast("int"), F.pmod(i, width).cast("int")))
                return use(at)

            return _let(blocks, with_blocks)

        return _let(F.struct(steps.alias("steps"), F.greatest(F.ceil(F.sqrt(F.size(steps))), F.lit(1)).cast("int").alias("width")), with_width)

    return run


def _empty() -> Column:
    return F.expr("cast(array() as array<struct<start:long,end:long,s:string,before:string,after:string>>)")


def _matches(text: Column, pattern: str, gate: str) -> Column:
    """[(start, end, s, before, after)]: leftmost non-overlapping matches, with what stands around them."""

    def build(found: Column) -> Column:
        pieces, hits = found["p"], found["m"]
        steps = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(pieces, i))).cast("long"))

        def place(at: Callable[[Column], Column]) -> Column:
            def one(h: Column, i: Column) -> Column:
                before = F.get(pieces, i)
                start = at(i) + F.length(before)
                return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("s"), F.right(before, F.lit(WINDOW)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"))

            return F.transform(hits, one)

        return F.when(F.size(hits) == 0, _empty()).otherwise(_offsets(steps)(place))

    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(gate), _let(found, build)).otherwise(_empty())


def _proposals(text: Column, pattern: str, gate: str) -> Column:
    """[(start, end, s, before, after)]: the pattern's match at every place where it has one; they may overlap.

    The match is looked at, not taken: the text, behind one more character, is cut where a match starts.
    """
    ahead = f"(?=({pattern}))".replace(r"\1", r"\2")

    def build(found: Column) -> Column:
        pieces, hits = found["p"], found["m"]
        steps = F.transform(pieces, lambda p: F.length(p).cast("long"))

        def place(at: Callable[[Column], Column]) -> Column:
            def one(h: Column, i: Column) -> Column:
                start = at(i + 1) - 1
                after = F.substring(F.get(pieces, i + 1), F.length(h) + 1, F.lit(1))
                return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("s"), F.right(F.get(pieces, i), F.lit(WINDOW)).alias("before"), after.alias("after"))

            return F.transform(hits, one)

        return F.when(F.size(hits) == 0, _empty()).otherwise(_offsets(steps)(place))

    behind = F.concat(F.lit("\n"), text)
    found = F.struct(F.split(behind, ahead, -1).alias("p"), F.regexp_extract_all(behind, F.lit(ahead), F.lit(1)).alias("m"))
    return F.when(text.rlike(gate), _let(found, build)).otherwise(_empty())


#: What a text must hold for a pattern to be tried.
BASE_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9\\x20-]{14}", "phone": r"\+[0-9]"}
GATES = {"email": [r"[\[({] ?(?:@|at|AT) ?[\])}]", r" (?:dot|DOT) "], "ip": [r"[0-9]\.[0-9]", r"[\[(]\.[\])]"], "card": ["[0-9]{16}", "[0-9]{4}[ ./_-][0-9]{4}[ ./_-]", "[0-9]{4}[ ./_-][0-9]{4}[ ./_-]"], "phone": [r"\+[0-9]", r"\+[0-9]", r"\([0-9]{3}\)", "00[0-9]"]}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _passes(kind: str, s: Column) -> Column:
    """The check that a match of the kind must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return F.regexp_replace(s, r"[\[\]()]", "").rlike(rf"^(?:{part}\.){{3}}{part}$")
    digits = _digits(s)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """Sure spans by kind: base matches that pass their check."""

    def sure(kind: str) -> Column:
        return F.filter(_matches(text, BASE[kind], BASE_GATES[kind]), lambda m: _passes(kind, m["s"]))

    return {kind: sure(kind) for kind in KINDS}


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a kind's sure spans overwritten, of the same length."""

    def build(s: Column) -> Column:
        gap = lambda m, i: F.substring(s["t"], F.when(i == 0, 0).otherwise(F.get(s["m"], i - 1)["end"]).cast("int") + 1, (m["start"] - F.when(i == 0, 0).otherwise(F.get(s["m"], i - 1)["end"])).cast("int"))
        pieces = F.transform(s["m"], lambda m, i: F.concat(gap(m, i), F.repeat(F.lit("\u0001"), F.length(m["s"]))))
        last = F.get(s["m"], F.size(s["m"]) - 1)["end"].cast("int")
        return F.concat(F.array_join(pieces, ""), F.substring(s["t"], last + 1, F.length(s["t"])))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(text.alias("t"), spans.alias("m")), build))


def _neighbour(c: Column) -> Column:
    """0 none, 1 space, 2 digit, 3 letter, 4 other."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\p{L}$"), 3).otherwise(4)


def _described(kind: str, gen: int, m: Column) -> Column:
    """A proposal's place and features."""
    n = F.length(_digits(m["s"]))
    return F.struct(
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(gen).alias("gen"),
        _passes(kind, m["s"]).cast("int").alias("ok"),
        F.when(n < 8, 0).when(n < 11, 1).when(n < 16, 2).when(n < 17, 3).otherwise(4).alias("digits"),
        F.least(F.size(F.array_distinct(F.split(F.regexp_replace(m["s"], r"[\p{L}0-9]", ""), ""))), F.lit(3)).alias("mixed"),
        _neighbour(F.right(m["before"], F.lit(1))).alias("before"),
        _neighbour(m["after"]).alias("after"),
        F.lower(m["before"]).rlike(CUES[kind]).cast("int").alias("cue"),
    )


def _proposed(kind: str, blank: Column) -> Column:
    """[(start, end, features)] of a text without its sure spans."""

    def by(gen: int) -> Column:
        return F.transform(_proposals(blank, GENERATORS[kind][gen], GATES[kind][gen]), lambda m: _described(kind, gen, m))

    return F.concat(*map(by, range(len(GENERATORS[kind]))))


def _examples(kind: str, spans: Column) -> Column:
    """[(start, end, features)]: what the generators propose inside sure spans and their rewritten forms, in the spans' places."""

    def by(gen: int) -> Column:
        pattern = f"({GENERATORS[kind][gen]})".replace(r"\1", r"\2")

        def seen(m: Column) -> Column:
            s = m["s"]
            for old, new in REWRITES[kind][gen]:
                s = F.regexp_replace(s, old, new)
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(s, pattern, 1).alias("s"), m["before"].alias("before"), m["after"].alias("after"))

        return F.transform(F.filter(F.transform(spans, seen), lambda m: m["s"] != ""), lambda m: _described(kind, gen, m))

    return F.concat(*map(by, range(len(GENERATORS[kind]))))


@dataclass
class Model:
    """By kind: the constant, trees of (feature, cut, left, right) over leaf values, and the least score that redacts."""

    constant: dict[str, float] = field(default_factory=dict)
    trees: dict[str, list] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    def score(self, kind: str, vector: tuple) -> float:
        def leaf(tree) -> float:
            while isinstance(tree, tuple):
                feature, cut, low, high = tree
                tree = low if vector[feature] <= cut else high
            return tree

        return 1 / (1 + math.exp(-(self.constant[kind] + sum(leaf(t) for t in self.trees[kind]))))

    def column(self, kind: str, features: Column) -> Column:
        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, cut, low, high = tree
            return F.when(features[FEATURES[feature]] <= cut, case(low)).otherwise(case(high))

        return 1 / (1 + F.exp(-(sum((case(t) for t in self.trees[kind]), F.lit(self.constant[kind])))))


Counts = dict[tuple, list[int]]  # feature vector -> [unlabelled, positive]


def _grow(rows: list[tuple[tuple, float, float]], depth: int):
    """A tree over (vector, gradient, curvature) by the gain of every cut; the value of a leaf is one Newton step."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None, None)
    for feature in range(len(FEATURES)) if depth else ():
        bins: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for vector, a, b in rows:
            bins[vector[feature]][0] += a
            bins[vector[feature]][1] += b
        left_g = left_h = 0.0
        for cut in sorted(bins)[:-1]:
            left_g, left_h = left_g + bins[cut][0], left_h + bins[cut][1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, feature, cut)
    if best[1] is None:
        return RATE * g / (h + 1)
    _, feature, cut = best
    return (feature, cut, _grow([r for r in rows if r[0][feature] <= cut], depth - 1), _grow([r for r in rows if r[0][feature] > cut], depth - 1))


def boost(counts: Counts) -> tuple[float, list]:
    """Constant and trees of the logistic loss over counted vectors; every vector weighs as often as it occurs."""
    rows = sorted(counts.items())
    total, positive = sum(sum(c) for _, c in rows), sum(c[1] for _, c in rows)
    constant = math.log((positive + 1) / (total - positive + 1))
    margin, trees = {v: constant for v, _ in rows}, []
    for _ in range(TREES):
        step = []
        for vector, (u, p) in rows:
            q = 1 / (1 + math.exp(-margin[vector]))
            step.append((vector, p - (u + p) * q, (u + p) * q * (1 - q)))
        tree = _grow(step, DEPTH)
        trees.append(tree)
        one = Model({"": 0.0}, {"": [tree]})
        for vector, _ in rows:
            value = one.score("", vector)
            margin[vector] += math.log(value / (1 - value))
    return constant, trees


def calibrate(model: Model, kind: str, counts: Counts, precision: float = PRECISION) -> float:
    """The least score from which on, over the calibration fold, this share of the examples is positive; above 1 if none has it."""
    by_score: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for vector, (u, p) in counts.items():
        at = by_score[model.score(kind, vector)]
        at[0], at[1] = at[0] + u, at[1] + p
    u = p = 0
    threshold = 2.0
    for score in sorted(by_score, reverse=True):
        u, p = u + by_score[score][0], p + by_score[score][1]
        if by_score[score][1] >= precision * sum(by_score[score]) and p >= precision * (u + p):
            threshold = score
    return threshold


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _text, sure spans and the blanked text of each kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("_key"), text.alias("_text"))
    out = out.select("_key", "_text", *[c.alias(kind) for kind, c in base_spans(F.col("_text")).items()])
    return out.select("*", *[_blanked(F.col("_text"), F.col(kind)).alias(f"{kind}_rest") for kind in KINDS])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all documents. What reaches the driver is one count a feature vector: some thousands at most, whatever the input."""
    seen = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    calibrates = crc_fold("_key", FOLDS) == 0

    def told(kind: str, label: int) -> Column:
        found = _examples(kind, F.col(kind)) if label else _proposed(kind, F.col(f"{kind}_rest"))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), *[m[f].alias(f) for f in FEATURES]))

    each = [told(kind, label) for kind in KINDS for label in (0, 1)]
    rows = seen.select(calibrates.alias("held"), F.explode(F.concat(*each)).alias("m")).select("held", "m.*")
    counts: dict[tuple, Counts] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in rows.groupBy("kind", "held", "label", *FEATURES).count().collect():
        counts[r["kind"], r["held"]][tuple(r[f] for f in FEATURES)][r["label"]] += r["count"]
    model = Model()
    for kind in KINDS:
        learns, holds = counts[kind, False], counts[kind, True]
        if any(p for _, p in learns.values()):
            model.constant[kind], model.trees[kind] = boost(learns)
            model.threshold[kind] = calibrate(model, kind, holds)
    return model


def _ordered(spans: Column) -> Column:
    """Of accepted spans (start, end): each once, in order, without those that lie in the one before."""
    return _let(
        F.array_sort(F.array_distinct(spans), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["end"] - a["end"])).cast("int")),
        lambda s: F.filter(s, lambda m, i: (i == 0) | (m["end"] > F.coalesce(F.get(s, i - 1)["end"], F.lit(-1)))),
    )


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, n_email, n_ip, n_card, n_phone (sure spans), base_sha256, spans, n_added.

    ``spans`` has sure and added spans as kind:start:end by kind, then start; positions count code points, the end is outside.
    Added spans of a kind lie outside its sure spans and may overlap each other, but none lies in the one before it. Of two
    proposals of one place both stay if neither holds the other. A null text is the empty text and has none; rows that repeat
    or have a null id are rows of their own. Without sure spans to learn from, nothing is added. Other columns are not read,
    whatever their names, and texts of any length are searched whole. An empty table gives an empty result.
    """
    seen = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")

    def added(kind: str) -> Column:
        if model.threshold.get(kind, 2.0) > 1:
            return none
        accepted = F.filter(_proposed(kind, F.col(f"{kind}_rest")), lambda m: model.column(kind, m) >= model.threshold[kind] - 1e-9)
        return _ordered(F.transform(accepted, place))

    seen = seen.select("_key", *[F.transform(kind, place).alias(kind) for kind in KINDS], *[added(kind).alias(f"{kind}_added") for kind in KINDS])

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    base = F.concat(*[named(kind, F.col(kind)) for kind in KINDS])
    every = F.concat(*[named(kind, F.array_sort(F.concat(kind, f"{kind}_added"))) for kind in KINDS])
    return seen.select(
        F.col("_key").alias(id_col),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        sum((F.size(f"{kind}_added") for kind in KINDS), F.lit(0)).cast("long").alias("n_added"),
    )
