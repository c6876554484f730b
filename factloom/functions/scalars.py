"""Column expressions shared by the operators: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("low", "medium", "high", "certain")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to four places; 0.0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def nullable_ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to four places; NULL where the whole is 0."""
    return F.when(whole != 0, F.round(part / whole, 4))


def glob_regex(glob: str) -> str:
    """A path glob (``**``, ``*``, ``?``, ``[abc]``, ``[!a-c]``, ``{a,b}``) as an anchored regular expression.

    Braces and brackets that are not closed stand for themselves; so does ``]`` right after the opening one.
    """
    out, i, ends = "", 0, []
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        close = glob.find("]", i + 2 + glob.startswith(("[!", "[^"), i)) if c == "[" else -1
        if close > 0:
            body = glob[i + 1 : close]
            negated = body[0] in "!^"
            out += "(?!/)[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]"
            i = close + 1
            continue
        if c == "{" and _closing(glob, i) > 0:
            ends.append(_closing(glob, i))
            out += "(?:"
        elif ends and i == ends[-1]:
            ends.pop()
            out += ")"
        elif ends and c == ",":
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


KEY_LENGTH = 16  # characters of a literal prefix or suffix that an index key has at most
ALTERNATIVES = 64  # spellings that braces are written out to at most; beyond, what stands before the first brace is the key


def _spellings(glob: str) -> list[str]:
    """The glob with its innermost-first braces written out; unchanged if there are too many."""
    found = [glob]
    while len(found) <= ALTERNATIVES:
        at = next((i for i, g in enumerate(found) if re.search(r"\{[^{}]*\}", g)), None)
        if at is None:
            return found
        g = found.pop(at)
        m = re.search(r"\{([^{}]*)\}", g)
        found += [g[: m.start()] + part + g[m.end() :] for part in m[1].split(",")]
    return [glob]


def glob_keys(glob: str) -> list[tuple[str, int, str]]:
    """(side, length, text): literal prefixes (p) or suffixes (s) of which a matching value has one; ("a", 0, "") if any value may match."""
    keys = set()
    for g in _spellings(glob.replace("**/", "*")):
        before, after = re.split(r"[*?\[\]{}]", g, maxsplit=1)[0][:KEY_LENGTH], re.split(r"[*?\[\]{}]", g)[-1][-KEY_LENGTH:]
        keys.add(("p", len(before), before) if before else ("s", len(after), after) if after else ("a", 0, ""))
    return [("a", 0, "")] if ("a", 0, "") in keys else sorted(keys)


def _closing(glob: str, start: int) -> int:
    """Where the brace at ``start`` is closed; -1: nowhere."""
    depth = 0
    for i in range(start, len(glob)):
        depth += (glob[i] == "{") - (glob[i] == "}")
        if not depth:
            return i
    return -1


def matches_any(path: Column, globs: list[str]) -> Column:
    return F.lit(False) if not globs else path.rlike("|".join(glob_regex(g) for g in globs))


def path_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Presentation filter: an empty include list takes all."""
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)


def underscore(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def camelize(name: Column, acronyms: dict[str, str] | None = None) -> Column:
    """``a/b_c`` becomes ``A::BC``; parts with a listed acronym become it."""
    listed = F.create_map(*[F.lit(x) for kv in sorted(acronyms.items()) for x in kv]) if acronyms else None

    def part(x: Column) -> Column:
        plain = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))
        return plain if listed is None else F.coalesce(listed[x], plain)

    return F.array_join(F.transform(F.split(name, "/"), lambda space: F.array_join(F.transform(F.split(space, "_"), part), "")), "::")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts joined by ``:``, which must not be null: a class and an id."""
    return F.sha2(F.array_join(F.array(*[p.cast("string") for p in parts]), ":"), 256)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.9, "certain").when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def rank_of(level: Column) -> Column:
    """Position of a confidence level, for threshold filters."""
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), level)


def nearest_rank(values: Column, percent: int) -> Column:
    """Nearest-rank percentile of a sorted array; NULL for an empty one."""
    at = F.ceil(F.size(values) * F.lit(percent) / 100.0).cast("int")
    return F.get(values, F.greatest(at, F.lit(1)) - 1)


def quarantine_status(annotation: Column, wanted: Column, as_of: Column, days: int) -> Column:
    """State of a quarantine annotation (a comment line) at a definition with the physical fingerprint ``wanted``.

    NULL without an annotation that has a date, invalid for a date that can't be read, fingerprint_required or
    stale_fingerprint by its fingerprints, review_required ``days`` after the date, else active.
    """
    text = F.coalesce(annotation, F.lit(""))
    since = F.regexp_extract(text, r"\bsince=([^\s]+)", 1)
    one = F.regexp_extract(text, r"\bfingerprint=([0-9a-f]{64})(?:\s|$)", 1)
    many = F.regexp_extract(text, r"\bfingerprints=([0-9a-f]{64}(?:,[0-9a-f]{64})*)(?:\s|$)", 1)
    given = F.when(one != "", F.array(one)).when(many != "", F.split(many, ","))
    day = F.try_to_date(since, "yyyy-MM-dd")
    return (
        F.when(~(text.contains("quarantine") & text.rlike(r"\bsince=")), F.lit(None).cast("string"))
        .when(day.isNull(), "invalid")
        .when(given.isNull() & ~text.rlike(r"\bfingerprints?="), "fingerprint_required")
        .when(~F.coalesce(F.array_contains(given, wanted), F.lit(False)), "stale_fingerprint")
        .when(day <= F.date_sub(as_of, days), "review_required")
        .otherwise("active")
    )


def loc(line: Column, end_line: Column) -> Column:
    """Lines of a definition: at least 1, and 0 without a line."""
    return F.when(F.coalesce(line > 0, F.lit(False)), F.greatest(F.coalesce(end_line, line) - line + 1, F.lit(1))).otherwise(0)


def metric_delta(on: Column, off: Column) -> Column:
    """Difference of two measures to four places; NULL if either is."""
    return F.round(on - off, 4)


def relative_limit(base: Column, ratio_: Column, allowance: Column, absolute: Column) -> Column:
    """A cap from a baseline: its multiple or its allowance, whichever is larger, at most the absolute cap, at least 0."""
    return F.greatest(F.lit(0.0), F.least(absolute, F.greatest(base * ratio_, base + allowance)))


def observation_days(started: Column, finished: Column) -> Column:
    """Days that an observation covers, begun ones counted, at least 1."""
    return F.greatest(F.lit(1), F.ceil((F.unix_micros(finished) - F.unix_micros(started)) / F.lit(86_400_000_000)))


def lower_camel(name: Column) -> Column:
    """``a_b?`` becomes ``aB?``."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def reference_tokens(name: Column) -> Column:
    """The spellings of a method name that a text may use: as it is, and lower camel case; none if it is no identifier."""
    shaped = name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*[!?=]?$")
    return F.when(shaped, F.array_distinct(F.array(name, lower_camel(name)))).otherwise(F.array().cast("array<string>"))


def method_name(symbol: Column) -> Column:
    """What follows the first ``.`` or ``#`` of a symbol; the symbol if there is none."""
    found = F.regexp_extract(symbol, "^[^.#]*[.#](.*)$", 1)
    return F.when(symbol.rlike("^[^.#]*[.#]"), found).otherwise(symbol)


def annotation_escape(message: Column) -> Column:
    """A message for one line of a CI annotation."""
    out = message
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def string_list(values: Column) -> Column:
    """Distinct non-empty strings of an array in order; NULL is the empty list."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(values.cast("array<string>"), none), lambda x: x.isNotNull() & (x != ""))))


def revision_status(given: Column, current: Column, stale: Column) -> Column:
    """stale, unknown (none given), provided_unverified (nothing to compare with), match or mismatch."""
    return F.when(F.coalesce(stale, F.lit(False)), "stale").when(F.coalesce(given, F.lit("")) == "", "unknown").when(F.coalesce(current, F.lit("")) == "", "provided_unverified").when(given == current, "match").otherwise("mismatch")


def bounded_snippet(line: Column, limit: int = 240) -> Column:
    """A line with runs of white space as one space, cut to ``limit`` bytes with an ellipsis."""
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(F.octet_length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.make_valid_utf8(F.substring(flat.cast("binary"), 1, limit).cast("string")), "\ufffd+$", ""), F.lit("…")))


def pluralize(noun: Column, irregular: dict[str, str], uncountable: list[str], rules: list[tuple[str, str]]) -> Column:
    """The plural by listed irregular and uncountable nouns, then the first of the rules (pattern, replacement), else with s."""
    out = F.when(noun.isin(*uncountable), noun) if uncountable else F.when(F.lit(False), noun)
    for one, many in irregular.items():
        out = out.when(noun == one, many)
    for pattern, replacement in rules:
        out = out.when(noun.rlike(pattern), F.regexp_replace(noun, pattern, replacement))
    return out.otherwise(F.concat(noun, F.lit("s")))


def constant_candidates(name: Column, nesting: Column) -> Column:
    """Qualified names of a constant from the innermost namespace outwards (``nesting``, innermost first), then the name itself."""
    return F.concat(F.transform(nesting, lambda n: F.concat(n, F.lit("::"), name)), F.array(name))
