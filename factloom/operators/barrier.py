"""Text barrier: definitions whose names occur in files that no parser covers, line by line, with the kind of each match."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.scalars import bounded_snippet, reference_tokens

#: Fixed names: folders of generated files, names too common for a plain match, keys before a method's name, frameworks by package.
GENERATED_PARTS = ("generated", "dist")
COMMON = ("call", "create", "destroy", "edit", "index", "new", "run", "show", "update")
KEYS = ("action", "callback", "command", "function", "handler", "method", "perform", "task")
FRAMEWORKS = ("active_model_serializers", "blueprinter", "graphql", "rails", "rubocop", "sidekiq", "view_component")
MARKER = "(?i)(?:@generated|automatically generated|generated file|do not edit)"
COMMENT_START = ("#", "//", "--", ";", "<!--", "<%#", "/*", "*")
#: Fixed inline comment markers by file extension.
INLINE = {
    "#": ("bash", "conf", "env", "gql", "graphql", "ini", "properties", "sh", "toml", "yaml", "yml", "zsh"),
    "//": ("c", "cc", "cpp", "css", "gql", "graphql", "h", "hpp", "js", "jsx", "scss", "ts", "tsx"),
    "--": ("sql",),
    ";": ("ini",),
}
BLOCK = r"(?s)<%#.*?%>|<!--.*?-->|/\*.*?\*/"
TAG = r"(?s)<%(?![%#])[-=]?(.*?)-?%>"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*(?:[!?=](?![A-Za-z0-9_]))?"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def generated_path(path: Column) -> Column:
    """Whether a path has a folder or name of generated files, or a minified name."""
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in GENERATED_PARTS])) | F.contains(F.element_at(parts, -1), F.lit(".min."))


def generated_header(text: Column) -> Column:
    """Whether the comment or blank lines that open a text (20 at most) say that it is generated."""
    head = F.slice(F.split(text, "\n"), 1, 20)
    opens = lambda line: (F.trim(line) == "") | F.trim(line).rlike("^(?:" + "|".join(re.escape(s) for s in COMMENT_START) + ")")
    first = F.array_position(F.transform(head, lambda x: ~opens(x)), F.lit(True))
    lead = F.when(first > 0, F.slice(head, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(head)
    return F.exists(lead, lambda x: x.rlike(MARKER))


def skip_reason(path: Column, text: Column, limit: int, metadata: list[str]) -> Column:
    """Why a file is not searched: tool_metadata, unreadable (null), binary (a NUL), oversized (bytes), generated; else NULL."""
    named = F.element_at(F.split(path, "/"), -1).isin(*metadata) if metadata else F.lit(False)
    big, zero = F.octet_length(text) > limit, F.contains(text, F.char(F.lit(0)))
    return F.when(named, "tool_metadata").when(text.isNull(), "unreadable").when(zero, "binary").when(big, "oversized").when(generated_path(path) | generated_header(text), "generated")


def blank_comments(text: Column) -> Column:
    """A text whose block comments are spaces of the same length; line ends stay."""
    rest, found = F.split(text, BLOCK, -1), F.regexp_extract_all(text, F.lit(f"({BLOCK})"), F.lit(1))
    gaps = F.transform(found, lambda c: F.regexp_replace(c, "[^\n]", " "))
    return F.array_join(F.flatten(F.transform(rest, lambda r, i: F.array(r, F.coalesce(F.get(gaps, i), F.lit(""))))), "")


def embedded(text: Column) -> Column:
    """The code inside a template's tags, tag by tag."""
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(1))


def template_names(files: DataFrame) -> DataFrame:
    """(path, name): distinct identifiers in the tags of templates (path, text), quoted texts and comments left out."""
    code = F.transform(embedded(F.col("text")), lambda c: F.regexp_replace(F.regexp_replace(c, "\"[^\"]*\"|'[^']*'", " "), "(?m)#.*$", " "))
    names = F.flatten(F.transform(code, lambda c: F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_:@$])([a-z_]\w*[!?]?)"), F.lit(1))))
    return files.select("path", F.explode(F.array_distinct(names)).alias("name"))


def view_names(files: DataFrame) -> DataFrame:
    """(name): what views (path, text) may call: names in the tags of .erb templates, identifiers of all other views."""
    erb = extension(F.col("path")) == "erb"
    text = F.regexp_replace(F.regexp_replace("text", "(?s)<!--.*?-->", ""), r"(?m)^\s*-#.*$", "")
    other = files.filter(~erb).select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z_]\w*[!?=]?)(?![A-Za-z0-9_])"), F.lit(1))).alias("name"))
    return template_names(files.filter(erb)).select("name").unionByName(other).distinct()


def frameworks(files: DataFrame) -> DataFrame:
    """(framework): those whose package a dependency file (path, text) names: a lock file's entries, or declarations."""
    name = F.element_at(F.split("path", "/"), -1)
    locked = F.regexp_extract_all("text", F.lit(r"(?m)^    ([A-Za-z0-9_.-]+) \("), F.lit(1))
    stated = F.regexp_extract_all("text", F.lit(r"(?m)^[^#\n]*?\b(?:gem|add_dependency|add_runtime_dependency|add_development_dependency)[ (]+[\"']([A-Za-z0-9_.-]+)[\"']"), F.lit(1))
    found = F.when(F.col("path") == "Gemfile.lock", locked).when((F.col("path") == "Gemfile") | F.endswith(name, F.lit(".gemspec")), stated)
    return files.select(F.explode(found).alias("framework")).filter(F.col("framework").isin(*FRAMEWORKS)).distinct()


def _patterns() -> dict[str, re.Pattern]:
    by_extension: dict[str, list[str]] = {}
    for marker, names in INLINE.items():
        for e in names:
            by_extension.setdefault(e, []).append(re.escape(marker))
    part = r"""(?:"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|[^"'])*?"""
    return {e: re.compile(rf"^({part})(?<!\S)(?:{'|'.join(m)}).*$", re.DOTALL) for e, m in by_extension.items()}


@F.pandas_udf(StringType())
def strip_inline(line: pd.Series, ext: pd.Series) -> pd.Series:
    """Lines without their inline comment: a marker of the extension, outside of quotes, at the start or after a space."""
    patterns = _patterns()
    return pd.Series([p.sub(r"\1", x) if x is not None and (p := patterns.get(e)) else x for x, e in zip(line, ext)], dtype=object)


def reference_kind(line: Column, token: Column, name: Column, owner: Column, ext: Column) -> Column:
    """The kind of a token's match with a definition; NULL: none.

    A capitalised qualifier must be the owner or its last part; with another one only what stands elsewhere counts. Symbols
    and quoted names count for all names; common names else only after a key or inside a template tag.
    """
    quoted = F.concat(F.lit("\\Q"), token, F.lit("\\E"))
    qualifier = F.concat(F.lit("(?<![A-Za-z0-9_:])([A-Z][A-Za-z0-9_:]*)(?:#|\\.)"), quoted, F.lit("(?![A-Za-z0-9_])"))
    owners = F.regexp_extract_all(line, qualifier, F.lit(1))
    qualified = F.size(owners) > 0
    right = F.coalesce(F.arrays_overlap(owners, F.array_compact(F.array(owner, F.element_at(F.split(owner, "::"), -1)))), F.lit(False))
    rest = F.when(qualified, F.regexp_replace(line, qualifier, F.lit(" "))).otherwise(line)
    direct = F.regexp_like(rest, F.concat(F.lit("(?<![\\p{Alnum}_])"), quoted, F.lit("(?![\\p{Alnum}_])")))
    symbol = F.regexp_like(rest, F.concat(F.lit("(?<![A-Za-z0-9_:]):"), quoted, F.lit("(?![A-Za-z0-9_])|[\"']"), quoted, F.lit("[\"']")))
    keyed = F.regexp_like(rest, F.concat(F.lit(f"(?i)(?:^|[,{{\\s])(?:{'|'.join(KEYS)})\\s*[:=]\\s*"), quoted, F.lit("(?![A-Za-z0-9_])")))
    structured = keyed | ((ext == "erb") & F.contains(rest, F.lit("<%")))
    kind = F.when(qualified & right, "qualified_owner").when(qualified & ~direct, None).when(symbol, "symbol_or_string")
    return kind.when(name.isin(*COMMON), F.when(structured, "structured_reference")).when(token == name, "method_name").otherwise("method_name_camelized")


def matches(files: DataFrame, nodes: DataFrame, limit: int = 10_000_000, metadata: list[str] | None = None, per_definition: int | None = None) -> DataFrame:
    """(definition_id, path, line, token, kind, snippet) of searched files (path, text) and nodes (definition_id, name, owner).

    Tokens are told apart once a line and met with the names' spellings by a join that carries no text; only the lines of
    matches are joined back (paths must be distinct). Names that are no identifiers are not searched for. ``per_definition`` keeps that many matches of a definition, by path and line, for a report; None keeps all.
    Null texts, and files with a ``skip_reason``, give no rows.
    """
    wanted = nodes.select("definition_id", "name", "owner", F.explode(reference_tokens(F.col("name"))).alias("token"))
    kept = files.filter(skip_reason(F.col("path"), F.col("text"), limit, metadata or []).isNull()).withColumn("ext", extension(F.col("path")))
    blank = blank_comments(F.col("text"))
    source = F.when(F.col("ext") == "erb", F.array_join(F.flatten(F.transform(F.split(blank, r"(?s)(?=<%)|(?<=%>)"), lambda x: F.array(F.when(x.startswith("<%"), x).otherwise(F.regexp_replace(x, "[^\n]", " "))))), "")).otherwise(blank)
    pairs = F.arrays_zip(F.split("text", "\n").alias("shown"), F.split(source, "\n").alias("line"))
    lines = kept.select("path", "ext", F.posexplode(pairs).alias("_at", "_p")).select("path", "ext", (F.col("_at") + 1).alias("line"), F.col("_p.shown").alias("_shown"), strip_inline("_p.line", "ext").alias("_line"))
    tokens = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("_line", F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    met = tokens.join(wanted, "token").join(lines, ["path", "line"])
    told = met.withColumn("kind", reference_kind(F.col("_line"), F.col("token"), F.col("name"), F.col("owner"), F.col("ext"))).filter("kind is not null")
    out = told.select("definition_id", "path", "line", "token", "kind", bounded_snippet(F.col("_shown")).alias("snippet"))
    if per_definition is None:
        return out
    first = out.groupBy("definition_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("path", "line", "token", "kind", "snippet"))), 1, per_definition).alias("m"))
    return first.select("definition_id", F.explode("m").alias("m")).select("definition_id", "m.*")
