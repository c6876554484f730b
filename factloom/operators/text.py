"""Text barriers: names that occur as tokens in files that no parser covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(texts: DataFrame, key: str, text: str, pattern: str = "[a-z]{4,}") -> DataFrame:
    """(key, token, n): counts inside each text are made before the shuffle."""
    tokens = texts.select(F.col(key), F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))).alias("token"))
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def mentioned(names: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(name, n_texts, n_mentions) of names that occur as tokens."""
    hits = token_counts(texts, key, text).join(names.select(F.col("name").alias("token")).distinct(), "token")
    return hits.groupBy(F.col("token").alias("name")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_mentions"))


def reference_kind(line: str):
    """The kind of a textual reference: qualified, symbol or plain."""
    c = F.col(line)
    return F.when(c.rlike("[A-Za-z]+[.#:]{1,2}[a-z_]+"), "qualified").when(c.rlike("[:'\"][a-z_]+"), "symbol").otherwise("plain")


def template_regions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_regions): embedded regions between <script> tags."""
    found = F.regexp_extract_all(F.col(text), F.lit("(?s)<script>(.*?)</script>"), F.lit(1))
    return texts.select(F.col(key), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_regions"))
