"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

A token budget flows down a domain, language, source tree. At every node the children share their parent's budget by
weight, none above its capacity (its tokens times the epoch limit); what a child cannot take goes to its siblings first,
and reaches an ancestor only when the whole family is full, because a family's capacity is the sum of its members'.
A leaf takes whole epochs and then the token-prefix of one more epoch, in that epoch's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut, key_text, packed

LEVELS = ("domain", "language", "source_name")
BROADCAST_LEAVES = 20_000
BITS = 10


def domain_of(source: Column) -> Column:
    """The domain rule of the registered query: sources numbered 0 to 9 are broad, the others niche."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when((number != "") & (number.cast("long") < 10), F.lit("broad")).otherwise(F.lit("niche"))


def tokens_of(text: Column) -> Column:
    """Whitespace-separated tokens of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-filling among siblings: nodes with _weight, _cap and their parent's _budget get _alloc.

    A child is full iff the family's need at the child's own fill level is within the budget; the level of the others is
    what remains, by weight. Weights must be positive.
    """
    ranked = Window.partitionBy(*parent).orderBy("_level", *[c for c in LEVELS if c in nodes.columns])
    rows = nodes.withColumn("_level", F.col("_cap") / F.col("_weight"))
    before = F.coalesce(F.sum("_cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_full", before + F.col("_level") * onward <= F.col("_budget"))
    family = Window.partitionBy(*parent)
    taken = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(family)
    weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(family)
    alloc = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", (F.col("_budget") - taken) * F.col("_weight") / weight))
    return rows.withColumn("_alloc", alloc).drop("_level", "_full")


def leaf_budgets(leaves: DataFrame, weights: dict[str, float], share_of_tokens: float, max_epochs: int) -> DataFrame:
    """Budget of every leaf from (domain, language, source_name, _tokens) rows.

    ``weights`` maps a node's name (``domain``, ``domain/language`` or ``domain/language/source``) to its weight among
    its siblings; nodes that are not named weigh 1. The whole budget is ``share_of_tokens`` of all tokens.
    """

    def weight(path: Column) -> Column:
        named = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
        return F.coalesce(named[path], F.lit(1.0)) if named is not None else F.lit(1.0)

    leaves = leaves.withColumn("_cap", F.col("_tokens").cast("double") * max_epochs)
    total = leaves.groupBy(F.lit(1).alias("_root")).agg((F.sum("_tokens").cast("double") * share_of_tokens).alias("_budget"))
    budgets, parent = total, ["_root"]
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(F.lit(1).alias("_root"), *keys).agg(F.sum("_cap").alias("_cap")).withColumn("_weight", weight(F.concat_ws("/", *keys)))
        shared = share(nodes.join(budgets, parent), parent)
        parent = ["_root", *keys]
        budgets = shared.select(*parent, F.col("_alloc").alias("_budget"))
    return budgets.join(leaves.select(*LEVELS, "_tokens"), list(LEVELS)).drop("_root")


def seeded(seed: int, epoch: Column, base: Column) -> Column:
    """60-bit order key of a document in one epoch, from md5 so that other engines can repeat it."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), base).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mixed_rows(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    share_of_tokens: float = 0.8,
    max_epochs: int = 2,
    seed: int = 11,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(_row, _domain, _n_tokens, _copies): all columns of a row as one struct, and how often the mix takes it.

    Nulls in language or source are leaves of their own; a null or empty text has no tokens and is taken as often as its
    leaf has whole epochs; equal rows share one order key and are taken together; an empty table gives an empty result;
    weights must be positive, or an error is raised.

    A hot leaf is never one task: its prefix is cut by a histogram of order keys, first by their top ``BITS`` bits, then
    inside the one bin that the cut falls into, so the last step compares each row with its leaf's cut key.
    """
    if any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    domain = domain_of(F.col(source_col)) if domain is None else domain
    base = F.concat_ws("|", key_text(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keys = {"domain": domain, "language": key_text(lang_col), "source_name": key_text(source_col)}
    narrow = cut(docs.select(*[v.alias(k) for k, v in keys.items()], tokens_of(F.col(text_col)).alias("_tokens"), base.alias("_base")))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("_tokens").alias("_tokens"))
    budgets = leaf_budgets(leaves, weights or {}, share_of_tokens, max_epochs)
    whole = F.when(F.col("_tokens") > 0, F.least(F.floor(F.col("_budget") / F.col("_tokens")), F.lit(max_epochs))).otherwise(0).cast("int")
    budgets = cut(budgets.withColumn("_whole", whole).withColumn("_rest", F.col("_budget") - F.col("_whole") * F.col("_tokens")).drop("_tokens"))
    hint = F.broadcast if budgets.count() <= BROADCAST_LEAVES else lambda x: x

    shift = 60 - BITS
    keyed = narrow.filter("_tokens > 0").join(hint(budgets), list(LEVELS)).withColumn("_key", seeded(seed, F.col("_whole") + 1, F.col("_base")))
    bins = keyed.groupBy(*LEVELS, "_rest", F.shiftright("_key", shift).alias("_bin")).agg(F.sum("_tokens").alias("_tokens"))
    over = Window.partitionBy(*LEVELS).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_tokens").over(over))
    edge = bins.filter(F.col("_upto") > F.col("_rest")).groupBy(*LEVELS).agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_tokens")).alias("_before")), "_bin").alias("_edge"))
    edge = cut(edge.select(*LEVELS, "_edge.*"))
    inside = keyed.withColumn("_bin", F.shiftright("_key", shift)).join(hint(edge), [*LEVELS, "_bin"])
    inside = inside.groupBy(*LEVELS, "_rest", "_before", "_key").agg(F.sum("_tokens").alias("_tokens"))
    within = Window.partitionBy(*LEVELS).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_tokens").over(within)).filter(F.col("_upto") <= F.col("_rest"))
    last = inside.groupBy(*LEVELS).agg(F.max("_key").alias("_last"))
    first_of_edge = edge.select(*LEVELS, (F.col("_bin") * F.lit(1 << shift) - 1).alias("_floor"))
    cuts = budgets.join(first_of_edge, list(LEVELS), "left").join(last, list(LEVELS), "left")
    cuts = cut(cuts.select(*LEVELS, "_whole", F.when(F.col("_floor").isNull(), F.lit((1 << 60) - 1)).otherwise(F.coalesce("_last", "_floor")).alias("_cut"), "_rest"))

    rows = packed(docs, **keys, _base=base, _n_tokens=tokens_of(F.col(text_col)))
    joined = rows.join(hint(cuts), list(LEVELS), "left")
    extra = (F.col("_rest") > 0) & (F.col("_whole") < max_epochs) & (seeded(seed, F.col("_whole") + 1, F.col("_base")) <= F.col("_cut"))
    copies = F.col("_whole") + F.when(extra & (F.col("_n_tokens") > 0), 1).otherwise(0)
    return joined.select("_row", F.col("domain").alias("_domain"), "_n_tokens", copies.cast("int").alias("_copies"))


def mix_sources(docs: DataFrame, *args, **options) -> DataFrame:
    """``docs`` with _domain, _n_tokens and _copies of ``mixed_rows``; columns of these three names in the input are replaced."""
    new = ["_domain", "_n_tokens", "_copies"]
    return mixed_rows(docs, *args, **options).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in new], *new)


def take_mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns, whatever their names."""
    taken = mixed_rows(docs, *args, **options).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
