import corpus_pipeline as P
from pyspark.sql import functions as F

from crumbline.llm import mixing, packing, pii
from tests.llm.test_shingle_dedup import brute
from tests.twins import DATA


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.cache()]
    for _, stage in P.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], DATA).cache())
        assert seen[-1].columns == docs.columns
    n = [d.count() for d in seen]
    assert 0.97 * n[0] <= n[1] <= n[0]
    kept = {r.doc_id for r in seen[2].select("doc_id").collect()}
    assert kept == set(brute([(r.doc_id, r.text) for r in seen[1].select("doc_id", "text").collect()]).values()) and n[2] == len(kept)
    assert n[3] == n[2]
    assert pii.with_spans(seen[3]).where(F.size("base") > 0).count() == 0
    words = mixing.n_words(F.col("text"))
    taken, there = (d.agg(F.sum(words)).first()[0] for d in (seen[4], seen[3]))
    assert abs(taken / there - 1.5) < 0.2
    pieces = P.pack(spark, seen[4], DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in seen[4].select("doc_id").distinct().collect()}
    assert pieces.columns == [*packing.FIELDS, "ids"]
    for d in seen:
        d.unpersist()


def test_odd_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the of and was on in " * 40, "en", None, 840), (2, "the of and was on in " * 40, "en", None, 840)]
    df = spark.createDataFrame(rows, kind)
    for frame in (df, df.limit(0)):
        out = frame
        for _, stage in P.STAGES:
            out = stage(spark, out, DATA)
        out.collect()


def test_no_stage_loses_rows_or_columns(spark):
    """Different texts under one id, rows without an id, columns that operators use names of, long texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60)
    a, b = (r.text for r in docs.where("n_chars > 300 and lang = 'en'").orderBy("doc_id").limit(2).collect())
    more = spark.createDataFrame([(5_000_001, a + " alpha", "en", "s", 1), (5_000_001, b + " beta gamma", "en", "s", 1), (None, "the " + a + " of", "en", None, None), (5_000_002, (b + " ") * 300, "en", "s", None)], docs.schema)
    docs = docs.union(more).selectExpr("*", "'kept' as language", "lang as accepted", "1 as component", "'n' as node", "text as doc", "2 as nth", "source as id", "3 as size", "'m' as mix", "'p' as spans")
    found = P.language(spark, docs, DATA).cache()
    assert found.columns == docs.columns and {r.language for r in found.select("language").distinct().collect()} == {"kept"}
    assert found.where("doc_id = 5000001").count() == 2 and found.where("doc_id = 5000002").count() == 1
    rows = [(i, r.doc_id, r.text) for i, r in enumerate(found.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect())]
    left = P.near_duplicates(spark, found, DATA).cache()
    assert left.columns == docs.columns
    assert left.count() == len(set(brute([(i, t) for i, _, t in rows]).values()))
    clean = P.personal_data(spark, left, DATA).cache()
    assert clean.columns == docs.columns and clean.count() == left.count()
    assert P.mix(spark, clean, DATA).columns == docs.columns
