"""Import of runtime observations: coverage payloads of several shapes, references to definitions, alive nodes and observed edges.

Observations are positive only: what was not seen says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import lookup
from factloom.operators.common import cut, paired
from factloom.operators.runtime import coverage_paths, line_interval_join, prefer

#: Fixed keys under which a payload keeps its files, and those that two merged observations must share.
WRAPPERS = ("files", "coverage", "runtime", "production")
SHARED = ("source_revision", "source_revision_status", "environment", "collector_name", "collector_version")
PRECISE = ("exact", "unique")


def _object(json: Column) -> Column:
    """A JSON object as a map of its raw values; NULL for anything else."""
    return F.when(F.ltrim(json).startswith("{"), F.from_json(json, "map<string,string>"))


def _positive(count: Column) -> Column:
    return F.coalesce(count.try_cast("int") > 0, F.lit(False))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def executed(lines: Column, nested: bool = True) -> Column:
    """Executed line numbers of one file's JSON: an array of counts by line (or of line numbers, if all are positive), an
    object of counts by line, or an object that holds one of these under ``lines`` or ``coverage``. NULL for other values."""

    def listed(counts: Column) -> Column:
        numbers = F.array_distinct(F.transform(counts, lambda c: c.try_cast("int")))
        places = F.filter(F.transform(counts, lambda c, i: F.when(_positive(c), i + 1)), lambda i: i.isNotNull())
        return F.when(F.forall(counts, _positive), numbers).otherwise(places)

    def by_line(m: Column) -> Column:
        keys = F.transform(F.map_keys(F.map_filter(m, lambda _, c: _positive(c))), lambda k: k.try_cast("int"))
        return _bound(F.coalesce(m["lines"], m["coverage"]), lambda inner: F.when(inner.isNotNull(), executed(inner, False)).otherwise(keys)) if nested else keys

    array = F.ltrim(lines).startswith("[")
    return F.when(array, _bound(F.from_json(lines, "array<string>"), listed)).otherwise(_bound(_object(lines), by_line))


def _files(payload: Column) -> Column:
    """The maps (path to JSON of lines) that a payload holds; NULL if it is no object."""
    inner = lambda j: _bound(_object(j), lambda o: _bound(_object(o["files"]), lambda f: F.coalesce(f, o)))
    wrapped = lambda m: F.filter(F.array(*[m[k] for k in WRAPPERS]), lambda x: x.isNotNull())
    held = lambda m: _bound(wrapped(m), lambda w: F.when(F.size(w) > 0, F.transform(w, inner)).otherwise(F.array(m)))
    return _bound(_object(payload), lambda m: F.when(m.isNotNull(), held(m)))


def coverage_files(payloads: DataFrame) -> DataFrame:
    """(run, path, line): distinct executed lines of all payloads (run, payload: JSON text).

    Files stand under any of ``WRAPPERS`` (there also one ``files`` deeper), or, without these, in the payload itself.
    Payloads that are null or no objects, and files without line data, give no rows. Every text is parsed once: outer
    explodes, because Spark repeats the expression of an inner one as a filter before it.
    """
    files = payloads.select("run", F.explode_outer(_files(F.col("payload"))).alias("files"))
    lines = files.select("run", F.explode_outer("files").alias("path", "lines"))
    flat = lines.select("run", "path", F.explode_outer(executed(F.col("lines"))).alias("line"))
    return flat.filter("line is not null").distinct()


def dense_counts(fields: Column, length: Column) -> Column:
    """The counts of lines 0 to length - 1 from a map of texts; lines that it lacks are NULL."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.try_element_at(fields, i.cast("string")).try_cast("int"))).otherwise(F.array().cast("array<int>"))


def merged_counts(left: Column, right: Column) -> Column:
    """Counts of two runs added line by line; a line neither has stays NULL, the longer array decides the length."""
    pair = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.transform(pair, lambda p: F.when(p["l"].isNotNull() | p["r"].isNotNull(), F.coalesce(p["l"], F.lit(0)) + F.coalesce(p["r"], F.lit(0))))


def merged_observation(left: Column, right: Column) -> Column:
    """Two maps of an observation's texts as one, the right one winning; a ``SHARED`` key with two values fails the query."""
    keys = F.array(*[F.lit(k) for k in SHARED])
    clash = lambda k, a, b: F.array_contains(keys, k) & a.isNotNull() & b.isNotNull() & (a != b)
    refuse = lambda k: F.raise_error(F.concat(F.lit("incompatible observations: "), k)).cast("string")
    return F.map_zip_with(left, right, lambda k, a, b: F.when(clash(k, a, b), refuse(k)).otherwise(F.coalesce(b, a)))


def reference(value: Column) -> Column:
    """A JSON reference as struct (identifier, definition_id, symbol_id, file, line); NULL if malformed.

    A text is an identifier. An object needs a non-empty symbol_id; definition_id and file may be missing or null, not
    empty; a line that is given must be a positive integer.
    """
    m = _object(value)
    text = F.when(F.ltrim(value).startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0])
    line = m["line"].try_cast("int")
    good = (F.length(m["symbol_id"]) > 0) & ((F.length(m["definition_id"]) > 0) | m["definition_id"].isNull()) & ((F.length(m["file"]) > 0) | m["file"].isNull()) & (m["line"].isNull() | F.coalesce(line > 0, F.lit(False)))
    none = F.lit(None).cast("string")
    as_text = F.struct(text.alias("identifier"), none.alias("definition_id"), none.alias("symbol_id"), none.alias("file"), F.lit(None).cast("int").alias("line"))
    as_object = F.struct(none.alias("identifier"), m["definition_id"].alias("definition_id"), m["symbol_id"].alias("symbol_id"), m["file"].alias("file"), line.alias("line"))
    return F.when(text.isNotNull(), as_text).when(good, as_object)


def _stated(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References, once each, with status, _way (id or symbol) and _target, the smallest definition that they may mean.

    Nodes of a symbol are counted before references meet them, so no pair of a reference and a symbol's node is formed.
    """
    given = refs.select("ref", "identifier", "definition_id", "symbol_id", "file", "line").distinct()
    plain = F.col("identifier").isNotNull()
    by_id = _by_id(given, nodes).groupBy("ref").agg(F.count(F.lit(1)).alias("_ids"), F.min("_id").alias("_by_id"))
    by_symbol = _symbols(given).join(lookup.narrowed_counts(nodes), lookup.ASKED).groupBy("ref").agg(F.sum("_n").alias("_symbols"), F.min("_target").alias("_by_symbol"))
    told = given.join(by_id, "ref", "left").join(by_symbol, "ref", "left")
    first, other = F.when(plain, F.lit("symbol")).otherwise("id"), F.when(plain, F.lit("id")).otherwise("symbol")
    held = lambda way: F.when(way == "id", F.col("_ids")).otherwise(F.col("_symbols"))
    told = told.withColumn("_way", F.when(held(first).isNotNull(), first).when(held(other).isNotNull(), other))
    status = F.when(F.col("_way").isNull(), "missing").when(F.col("_way") == "id", "exact").when(F.col("_symbols") == 1, "unique").otherwise("ambiguous")
    target = F.when(F.col("_way") == "id", F.col("_by_id")).when(F.col("_way") == "symbol", F.col("_by_symbol"))
    return told.select(*given.columns, status.alias("status"), "_way", target.alias("_target"))


def _by_id(given: DataFrame, nodes: DataFrame) -> DataFrame:
    """``given`` with the nodes (_id) of their ids; a node must fit the symbol, file and line that stand beside the id."""
    n = nodes.select(F.col("definition_id").alias("_id"), F.col("symbol_id").alias("_s"), F.col("file").alias("_f"), F.col("line").alias("_l"))
    plain = F.col("identifier").isNotNull()
    fits = (F.col("symbol_id") == F.col("_s")) & (F.col("file").isNull() | (F.col("file") == F.col("_f"))) & (F.col("line").isNull() | (F.col("line") == F.col("_l")))
    met = given.join(n, F.when(plain, F.col("identifier")).otherwise(F.col("definition_id")) == F.col("_id"))
    return met.filter(plain | F.coalesce(fits, F.lit(False))).drop("_s", "_f", "_l")


def _symbols(given: DataFrame) -> DataFrame:
    """``given`` that may be meant by symbol, with the keys of ``lookup.asked``; a bare identifier asks for any file and line."""
    plain = F.col("identifier").isNotNull()
    hinted = F.col("definition_id").isNull() | F.col("file").isNotNull() | F.col("line").isNotNull()
    narrow = lambda c: F.when(~plain, F.col(c))
    return given.filter(plain | hinted).select("*", *lookup.asked(F.coalesce("identifier", "symbol_id"), narrow("file"), narrow("line")))


def resolve_ends(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, status, definition_id): as ``resolve``, but one row for each reference, with the smallest definition that it may mean."""
    return _stated(refs, nodes).select("ref", "status", F.col("_target").alias("definition_id"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, status, definition_id): one row for each definition that a reference may mean, one with NULL if there is none.

    ``refs`` (ref, identifier, definition_id, symbol_id, file, line), ``nodes`` (definition_id, symbol_id, file, line). An
    identifier is a symbol first (unique, ambiguous), then an id (exact). Otherwise an id whose node fits the symbol, file and
    line is exact; a wrong id without file or line is missing; else symbol, file and line decide. References without
    symbol are missing. Repeated references are one. The pairs of references and nodes are what the last joins give out, those of a
    symbol in cells of bounded size; only references and nodes are shuffled.
    """
    stated = cut(_stated(refs, nodes))
    by_id = _by_id(stated.filter("_way = 'id'"), nodes).select("ref", "status", F.col("_id").alias("definition_id"))
    asked = _symbols(stated.filter("_way = 'symbol'")).select("ref", "status", *lookup.ASKED)
    by_symbol = paired(asked, lookup.narrowings(nodes), lookup.ASKED, "definition_id").select("ref", "status", "definition_id")
    lost = stated.filter("_way is null").select("ref", "status", F.col("_target").alias("definition_id"))
    return by_id.unionByName(by_symbol).unionByName(lost)


def alive(resolved: DataFrame) -> DataFrame:
    """(definition_id): all that resolved references may mean, ambiguous ones too."""
    return resolved.filter("definition_id is not null").select("definition_id").distinct()


def observed_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """(edge, caller_id, callee_id, match): matched edges have two precise ends and their ids; partially_matched, unmatched.

    ``edges`` (edge, caller, callee) with references as in ``resolved`` (ref, status, definition_id).
    """
    end = lambda name: resolved.groupBy(F.col("ref").alias(name)).agg(F.first("status").alias(f"_{name}"), F.min("definition_id").alias(f"{name}_id"))
    both = edges.join(end("caller"), "caller", "left").join(end("callee"), "callee", "left")
    precise = F.col("_caller").isin(*PRECISE) & F.col("_callee").isin(*PRECISE)
    none = F.col("caller_id").isNull() & F.col("callee_id").isNull()
    match = F.when(precise, "matched").when(none, "unmatched").otherwise("partially_matched")
    ids = [F.when(precise, F.col(c)).alias(c) for c in ("caller_id", "callee_id")]
    return both.select("edge", *ids, match.alias("match"))


def match_counts(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, attempted, matched, partially_matched, unmatched) of nodes and edges."""
    nodes = resolved.select("ref", "status").distinct().select(F.lit("nodes").alias("kind"), F.when(F.col("status").isin(*PRECISE), "matched").when(F.col("status") == "ambiguous", "partially_matched").otherwise("unmatched").alias("match"))
    rows = nodes.unionByName(edges.select(F.lit("edges").alias("kind"), "match"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col("match") == m).alias(m) for m in ("matched", "partially_matched", "unmatched")])


def import_references(structured: DataFrame, legacy: DataFrame, nodes: DataFrame, producer: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, malformed): alive evidence (definition_id, producer, grade) of both kinds of references, and bad ones.

    ``structured`` (value: JSON), ``legacy`` (symbol_id): a symbol that a structured reference names is not taken again.
    """
    read = structured.select("value", reference(F.col("value")).alias("r"))
    good = read.filter("r is not null").select(F.xxhash64("value").alias("ref"), "r.*", F.lit(0).alias("_p"), F.col("r.symbol_id").alias("_k"))
    none = F.lit(None).cast("string")
    old = legacy.select(F.xxhash64("symbol_id").alias("ref"), F.col("symbol_id").alias("identifier"), none.alias("definition_id"), none.alias("symbol_id"), none.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("_p"), F.col("symbol_id").alias("_k"))
    texts = good.filter("_k is null")
    both = prefer(good.filter("_k is not null").unionByName(old), ["_k"], "_p").unionByName(texts)
    seen = alive(resolve(both, nodes)).select("definition_id", F.lit(producer).alias("producer"), F.lit("observed").alias("grade"))
    return seen, read.filter("r is null").select("value")


def import_lines(covered: DataFrame, explicit: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alive, ambiguous): definitions whose lines were executed or whose ids were given, and lines (file, line,
    definition_ids) inside more than one of them.

    ``covered`` (path, line), ``explicit`` (definition_id), ``definitions`` (definition_id, file, first, last).
    """
    paths = coverage_paths(definitions.select("file"), covered.select("path").distinct())
    hits = covered.join(paths, "path").select("file", "line").distinct()
    met = line_interval_join(hits, definitions)
    ids = met.select("definition_id").unionByName(explicit.select("definition_id")).distinct()
    many = met.groupBy("file", "line").agg(F.array_sort(F.collect_set("definition_id")).alias("definition_ids")).filter(F.size("definition_ids") > 1)
    return ids, many
