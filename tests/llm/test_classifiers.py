import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid, toxicity
from tessella.llm.entries import QUERIES
from tessella.llm.shared import bounded_sample, fold

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in both) / len(both) > 0.97
    assert all(0 <= r.score <= 1 for r in both) and not any(r.rejected for r in both)


def test_language_edge_cases(spark):
    rows = [(1, "the cat sat on the mat with the other cat", "en"), (2, "der hund und die katze und das haus", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !!", "en"), (6, "und " * 50000, None), (1, "the", "en"), (None, "the", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    got = langid.identify(df, model, out_col="language").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r.language for r in got}
    for key in ((3, None), (4, ""), (5, "123 !!")):
        assert by[key].lang == "und" and by[key].rejected and by[key].score == 0
    assert by[1, rows[0][1]].lang == "en" and by[6, "und " * 50000].lang == "de"
    nothing = langid.fit(df.limit(0))
    assert {r.language.lang for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_far_text_is_rejected():
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choice("the of and to in that house water".split()) for _ in range(60)), "en") for _ in range(40)]
    model = langid.train(rows)
    assert model.predict([rows[0][0]])[0][2] is False
    assert model.predict(["жук щука хлеб вода молоко " * 12])[0][2] is True


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, learn_from=fold("doc_id") != 0)
    held = docs.join(labels, "doc_id").filter(fold("doc_id") == 0)
    got = toxicity.score(held, model).select("toxic", "score").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.93
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.score >= 0.5 for r in clean) / len(clean) < 0.03


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, "awful awful awful"), (3, None), (4, ""), (5, "w" * 100000), (1, "fine words here"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("clash")).withColumn("kind", F.lit(1)), model).collect()
    assert len(got) == 7 and all(abs(r.score - 1 / 3) < 1e-9 for r in got)  # too few to train on: the share of toxic documents
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    big = toxicity.fit(*tables(spark, 400))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, big).collect()}
    assert scores[3] == scores[4] and all(0 <= x <= 1 for x in scores.values())


def tables(spark, n, words=("river stone cloud paper field glass", "vile nasty awful")):
    """Documents and labels; every tenth has words of the second kind in every other place."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        told = [rnd.choice(words[0].split()) for _ in range(30)]
        if i % 10 == 0:
            told[::2] = [rnd.choice(words[1].split()) for _ in range(15)]
        rows.append((i, " ".join(told), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_does_not_depend_on_the_rates_of_the_sample(spark):
    docs, labels = tables(spark, 3000, ("river stone cloud paper field glass",) * 2)
    for sample in ({}, {"sample_toxic": 150, "sample_ordinary": 300}):
        model = toxicity.fit(docs, labels, **sample)
        scores = [model.score(r.text) for r in docs.collect()]
        assert abs(sum(scores) / len(scores) - 0.1) < 0.03  # texts say nothing here, so scores are the share of toxic documents


def test_one_id_with_many_rows_does_not_exceed_the_samples(spark):
    docs, labels = tables(spark, 600)
    hot = spark.range(20000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("river stone cloud "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(hot)
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("kind"), "text")
    counts, drawn = bounded_sample(rows, {0: 300, 1: 50}, 1_000_000, "x")
    by = {r.kind: r["count"] for r in drawn.groupBy("kind").count().collect()}
    assert counts == {0: 20540, 1: 60} and by == {0: 300, 1: 50}
    assert bounded_sample(rows, 10**6, 5000, "x")[1].groupBy("kind").agg(F.sum(F.length("text"))).agg(F.max("sum(length(text))")).first()[0] <= 5000
    same = docs.limit(1).crossJoin(spark.range(20000)).select("doc_id", "text").union(docs.limit(50))
    assert bounded_sample(same.select(F.col("doc_id").alias("id"), F.lit("a").alias("kind"), "text"), 40, 10**6, "x")[1].count() == 40
    model = toxicity.fit(docs, labels, sample_toxic=60, sample_ordinary=2000)
    assert model.score("vile nasty awful " * 5) > 0.5 > model.score("river stone paper " * 5)
    named = hot.withColumn("lang", F.lit("en")).union(spark.createDataFrame([(i, "der hund und die katze und das haus " + str(i), "de") for i in range(30)], "doc_id long, text string, lang string"))
    model = langid.fit(named, sample_docs=400)
    assert [p[0] for p in model.predict(["stone cloud river", "die katze und der hund"])] == ["en", "de"]


def test_score_by_brute_force(spark):
    """The lengths by separate frames of a plain compressor, the share and the steps in plain Python."""
    docs, labels = tables(spark, 400)
    model = toxicity.fit(docs, labels)
    import zstandard

    def length(book, window):
        made = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(book), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(made.compress(window))

    for r in toxicity.score(docs, model).limit(40).collect():
        words, cut = toxicity.normal(r.text), []
        while words:
            at = words[: toxicity.WINDOW].rfind(b" ", 1) if len(words) > toxicity.WINDOW else -1
            at = at if at > 0 else toxicity.WINDOW
            cut.append(words[:at])
            words = words[at:]
        share = sum(length(model.ordinary, w) - length(model.both, w) >= model.gain for w in cut) / (len(cut) + toxicity.SHRINK)
        below = max(i for i, x in enumerate(model.shares) if x <= share) if share >= model.shares[0] else 0
        above = min(below + 1, len(model.shares) - 1)
        gap = model.shares[above] - model.shares[below]
        want = model.chances[below] + (model.chances[above] - model.chances[below]) * ((share - model.shares[below]) / gap if gap else 0)
        assert abs(r.score - min(max(want, model.chances[0]), model.chances[-1])) < 1e-9


def test_isotonic_steps():
    rnd = np.random.default_rng(5)
    x, y, w = rnd.integers(0, 6, 60).astype(float), rnd.integers(0, 2, 60).astype(float), rnd.integers(1, 4, 60).astype(float)
    knots, values, off = toxicity.isotonic(x, y, w)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    mean = lambda a, b: np.average(y[(x >= a) & (x <= b)], weights=w[(x >= a) & (x <= b)])
    at = np.unique(x)
    for v in at:  # the known form: the greatest over starts of the least over ends of means
        want = max(min(mean(a, b) for b in at if b >= v) for a in at if a <= v)
        assert abs(np.interp(v, knots, values) - want) < 1e-9


def test_windows_cover_the_whole_text():
    rnd = random.Random(2)
    for _ in range(200):
        data = toxicity.normal(" ".join("x" * rnd.randrange(1, 90) for _ in range(rnd.randrange(1, 40))))
        assert b"".join(toxicity.windows(data)) == data


def test_only_windows_with_telling_strings_are_compressed(monkeypatch):
    """Windows that no telling string is in gain nothing, told by compressing them all; each string is found wherever it lies."""
    rnd = random.Random(4)
    common, marked = ([f"{a}{b}" for a in x.split() for b in y.split()] for x, y in (("ri sto clo pa fie gla", "ver ne ud per ld ss"), ("vi na aw ba", "le sty ful d")))
    phrases = [[rnd.choice(common) for _ in range(10)] for _ in range(60)]
    texts = [" ".join(rnd.choice(marked) if i % 8 == 0 and j % 5 == 0 else x for j, x in enumerate(sum(rnd.choices(phrases, k=6), []))) for i in range(900)]
    model = toxicity.train([(t, int(i % 8 == 0)) for i, t in enumerate(texts)])
    texts += [None, "", "x", " ".join(rnd.choice(marked) for _ in range(60)), "\0" * 90, *(x.decode() for x in model.told if x.isascii())]
    list(model.gains(texts[:1]))
    (plain, toxic), calls = model._pair, []
    model._pair = (lambda w: calls.append(w) or plain(w)), toxic
    found = list(model.gains(texts))
    cut = [toxicity.windows(toxicity.normal(t)) for t in texts]
    assert [len(g) for g in found] == [len(ws) for ws in cut]
    assert [g.tolist() for g in found] == [[len(plain(w)) - len(toxic(w)) for w in ws] for ws in cut]
    assert set(calls) == {w for ws in cut for w in ws if any(x in w for x in model.told)} and len(calls) == len(set(calls)) < sum(map(len, cut)) * 0.6
    data = b"".join(sum(cut, []))
    pairs = lambda: sorted(zip(*(x.tolist() for x in model._places(data)), strict=True))
    want = pairs()
    for size in (7, 1000):
        monkeypatch.setattr(toxicity, "SEARCHED", size)
        assert pairs() == want


def test_training_takes_place_outside_the_driver(spark, monkeypatch):
    """Neither the sample nor what training takes is in the driver's memory."""
    ident = spark.createDataFrame([(i, f"the house of number {i} and the garden" if i % 2 else f"das Haus der Nummer {i} und der Garten", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    docs, labels = tables(spark, 400)

    def refused(*_):
        raise AssertionError("the driver trains")

    with monkeypatch.context() as here:  # a worker has the module as it is
        here.setattr(langid, "train", refused)
        here.setattr(toxicity, "train", refused)
        model, marked = langid.fit(ident), toxicity.fit(docs, labels)
    assert [lang for lang, _, _ in model.predict(["the garden", "der Garten"])] == ["en", "de"]
    assert marked.both and len(marked.chances) > 1
