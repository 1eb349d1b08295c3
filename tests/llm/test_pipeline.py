"""The pipeline stage by stage against brute force."""

import corpus_pipeline
from veilspark.llm import queries

from .test_llm_operators import naive_leaks, naive_lines, naive_near


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]

    good = stages["quality"](spark, docs, sf).cache()
    assert {i for i, _ in pairs(good)} == {r["doc_id"] for r in queries.QUERIES["op7_quality"](spark, sf).where("kept").collect()}
    left = stages["line_dedup"](spark, good, sf).cache()
    assert left.columns == docs.columns
    assert sorted(pairs(left)) == sorted((i, t) for i, t, _, _ in naive_lines(pairs(good)))
    assert left.where("n_chars != length(text)").count() == 0
    single = stages["near_dedup"](spark, left, sf).cache()
    assert sorted(i for i, _ in pairs(single)) == sorted(i for i, _, _, kept in naive_near(pairs(left)) if kept)
    clean = stages["decontamination"](spark, single, sf).cache()
    assert clean.columns == docs.columns
    assert sorted(i for i, _ in pairs(clean)) == sorted(i for i, _, hit, _ in naive_leaks(pairs(single), bench) if not hit)
    tokens = stages["tokens"](spark, clean, sf)
    assert tokens.count() == clean.count() and tokens.where("n_tokens != size(ids)").count() == 0
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in tokens.collect())


def test_empty_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(1).selectExpr("cast(777 as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf)
    ids = [r["doc_id"] for r in odd.collect()]
    assert 777 not in ids
