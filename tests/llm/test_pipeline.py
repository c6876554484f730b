"""The stages of the corpus pipeline, each on what its predecessor kept, beside a brute-force version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import mixing, sharding, toxicity
from factloom.llm.common import stored, table
from factloom.llm.queries import QUERIES, WEIGHTS
from tests_of_operators import brute_decontam, brute_links, brute_mix, leaf_rows

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return Counter(df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty texts, repeated rows and columns with the operators' own names."""
    base = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark").first().text
    copy = base.orderBy(F.desc("n_chars")).first()
    more = [(None, None, None, None, None), (900_001, "", "en", "src1", 0), (900_002, "x " + bench + " y", "en", "src1", 9), (900_003, copy.text, "en", "src3", 9), (900_003, copy.text, "en", "src3", 9), (900_004, copy.text + " end", None, None, 9)]
    docs = base.unionByName(spark.createDataFrame(more, base.schema))
    return stored(docs.select("*", F.lit(7).alias("n_hit"), F.lit("a").alias("_gid"), F.lit("b").alias("_domain"), F.lit(1.5).alias("t1"), F.lit("c").alias("_leaf_whole")))


def test_toxicity_stage(spark, odd):
    model = toxicity.fit(odd, table(spark, SF, "labels"))
    bad = {(r.doc_id, r.predicted) for r in toxicity.score_toxicity(odd, model).collect()}
    want = Counter(r for r in odd.collect() if (r.doc_id, 1) not in bad)
    assert rows_of(STAGES["toxicity"](spark, odd, SF)) == want


def test_near_copies_stage(spark, odd):
    from fractions import Fraction

    rows = odd.collect()
    classes = {(i, name) for i, name, _ in brute_links(rows, Fraction("0.8"))}
    named = dict(classes)
    want = Counter(r for r in rows if r.doc_id is None or named[r.doc_id] is None or named[r.doc_id] == r.doc_id)
    assert rows_of(STAGES["ngram_join"](spark, odd, SF)) == want and sum(want.values()) < len(rows)


def test_decontamination_stage(spark, odd):
    rows, items = odd.collect(), table(spark, SF, "benchmark").collect()
    dirty = {i for i, _, hit, *_ in brute_decontam(rows, items) if hit}
    assert rows_of(STAGES["decontamination"](spark, odd, SF)) == Counter(r for r in rows if r.doc_id not in dirty) and 900_002 in dirty


def test_mixing_stage(spark, odd):
    want = brute_mix(leaf_rows(odd), WEIGHTS, 0.8, 2)
    names = Counter()
    for (i, _, copies), n in want.items():
        names[i] += copies * n
    got = Counter("\x00null" if r.doc_id is None else str(r.doc_id) for r in STAGES["mixing"](spark, odd, SF).collect())
    assert got == +names
    assert STAGES["mixing"](spark, odd, SF).columns == odd.columns == mixing.take_mix(odd).columns


def test_sharding_stage(spark, odd):
    got = STAGES["sharding"](spark, odd, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert rows_of(sharding.shard_documents(odd, n_shards=16)) == Counter(got)


def test_run_is_its_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert list(STAGES) == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    assert rows_of(docs.select("doc_id", "shard", "slot")) == rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot"))


def test_empty_table(spark, odd):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "sharding" or out.columns == odd.columns)


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
