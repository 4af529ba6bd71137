import re

from tessella.llm import licenses

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def check(spark, df):
    got = licenses.summary(licenses.scan(df)).collect()
    texts = df.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *[str(x) for x in r[1:]])
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(r.doc_id, *brute(r.text)) for r in texts], key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    return got


def test_whole_table(spark):
    got = check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert any(r.labels for r in got)


def test_edge_cases(spark):
    mit = licenses.TEMPLATES[0][0]
    edited = mit.replace("software and", "program and all")  # a changed word and one more
    rows = [
        (1, None), (2, ""), (3, "MIT"), (4, "MIT-License mit/LICENSE mit license"), (5, "cc by cc by nc"), (6, "x " * 30000 + "Apache License"), (7, "GNU General\nPublic License, gnu gnu general public license"),
        (8, f"so {edited}!"), (9, "permission is granted"), (10, "É mit licensé"), (None, "mit license"), (4, "mit license"), (4, "mit license"),
    ]
    got = check(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string"))
    by = {r.doc_id: r for r in got if r.doc_id not in (4, None)}
    assert by[5].labels == "cc-by,cc-by-nc" and by[8].labels == "mit" and by[8].base_labels == "" and 0.8 <= by[8].score < 1 and by[9].labels == ""
    assert licenses.summary(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.summary(licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan
