import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm.entries import MIX_TARGETS, vocabulary
from tests.llm.test_setjoin import brute, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(900001, "12 !! 34", None, None, 3), (900002, None, "en", "x", 0), (900003, "", None, "x", 0), (None, "the and of to nothing else matters here", None, None, 1)]
    first = docs.unionByName(spark.createDataFrame(junk, docs.schema)).unionByName(docs.limit(3))
    kept = corpus_pipeline.durable(corpus_pipeline.identify_language(spark, first, SF), "t")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in first.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id").collect() if r.doc_id} == {900001, 900002, 900003}

    clean = corpus_pipeline.durable(corpus_pipeline.drop_toxic(spark, kept, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ordinary = kept.join(labels.filter("toxic = 0"), "doc_id").count()
    assert clean.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.95 * ordinary

    once = corpus_pipeline.durable(corpus_pipeline.keep_one_of_each(spark, clean, SF), "t")
    extra = clean.withColumn("_rank", F.lit(1)).withColumn("_Mark", F.lit(2)).withColumn("_language", F.lit("x")).withColumn("_toxicity", F.lit(0.5)).withColumn("_copies", F.lit(9)).withColumn("_use", F.lit(3))
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_toxic, corpus_pipeline.keep_one_of_each, corpus_pipeline.mix_languages):
        assert stage(spark, extra.limit(0), SF).collect() == []
        kept_rows = stage(spark, extra.limit(40), SF)
        assert kept_rows.columns == extra.columns
        assert {(r._rank, r._Mark, r._language, r._toxicity, r._copies, r._use) for r in kept_rows.collect()} == {(1, 2, "x", 0.5, 9, 3)}

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    want = sorted({d for d, _, c in brute(rows) if d is not None and d == c})
    assert sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == want
    assert sum(len(shingles(r.text)) > 0 for r in once.collect()) == len(want) + 1

    mixed = corpus_pipeline.durable(corpus_pipeline.mix_languages(spark, once, SF), "t")
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.select("doc_id").distinct().collect()} == {r.doc_id for r in once.select("doc_id").collect()}
    share = {r.lang: r.n for r in mixed.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    before = {r.lang: r.n for r in once.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    off = lambda s: sum(abs(s.get(k, 0) / sum(s.values()) - v) for k, v in MIX_TARGETS.items())
    assert off(share) < max(0.2, off(before))

    library = Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in corpus_pipeline.encode(spark, mixed, SF).collect():
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_rows_of_one_id_with_different_texts(spark):
    words = lambda k: " ".join(f"w{k}-{i}" for i in range(30))
    rows = [(1, words(1)), (1, words(2)), (2, words(2)), (3, words(3)), (3, words(3)), (0, words(1)), (4, None), (4, ""), (None, words(1)), (5, words(4)), (6, words(4) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()), key=str)
    named = [(d, t) for d, t in got if d is not None and d != 4]
    assert sorted(named) == [(0, words(1)), (1, words(2)), (3, words(3)), (5, words(4))]
    assert [d for d, _ in got].count(4) == 1 and (None, words(1)) in got


def test_a_rare_language_is_repeated_a_bounded_number_of_times(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.filter("lang = 'en'").unionByName(docs.filter("lang = 'es'").limit(1))
    got = corpus_pipeline.mix_languages(spark, few, SF).groupBy("doc_id").count().collect()
    assert len(got) == few.count() and 1 <= min(r["count"] for r in got) and max(r["count"] for r in got) <= corpus_pipeline.MOST_COPIES


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
    assert len(corpus_pipeline.STAGES) == 5
