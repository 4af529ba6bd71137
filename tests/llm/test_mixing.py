import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing

SF = "/root/testdata/sf0.01"


def table_of(spark, n, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")


def brute(n, p, weights, lowest, total):
    """Plain projected gradients in the same metric with many small steps."""
    r = np.ones(len(n))
    x = n[:, None] * p
    target = np.array(weights) / sum(weights) * total
    w = np.linalg.pinv(x.T @ p, rcond=1e-9, hermitian=True)
    for _ in range(4000):
        r = np.maximum(lowest, r - 0.2 * p @ (w @ (r @ x - target)))
    return r, r @ x, target


@pytest.mark.parametrize("lowest", [0.0, 1.0])
def test_rates_reach_targets(spark, lowest):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.2, 0.1], 400)
    n = rng.integers(0, 500, 400)
    weights = [0.2, 0.5, 0.3]
    table = table_of(spark, n, p)
    steps, reached, target = mixing.fit_rates(table, weights, lowest=lowest)
    _, want, _ = brute(n.astype(float), p, weights, lowest, target.sum())
    if lowest == 0:
        assert np.abs(reached - target).sum() < 1e-3 * target.sum()
        assert np.abs(reached - want).max() < 2e-3 * target.sum()
    else:  # the targets can't be met: compare how far off either is, in the metric of the steps
        w = np.linalg.pinv((n[:, None] * p).T @ p, hermitian=True)
        off = lambda a: float((a - target) @ w @ (a - target))
        assert off(want) * 0.999 <= off(reached) < 0.5 * off(n @ p)
    rates = [r[0] for r in table.select(mixing.rate_of(steps, lowest)).collect()]
    assert min(rates) >= lowest
    assert np.allclose(np.array(rates) @ (n[:, None] * p), reached)


def test_rates_are_never_negative_where_targets_cannot_be_met(spark):
    p = np.array([[0.5, 0.5]] * 20 + [[0.9, 0.1]] * 5)
    n = np.full(25, 100)
    steps, reached, target = mixing.fit_rates(table_of(spark, n, p), [0.01, 0.99], most_steps=60)
    r, want, _ = brute(n.astype(float), p, [0.01, 0.99], 0.0, target.sum())
    assert np.abs(reached - want).max() < 0.02 * target.sum()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tags = docs.filter("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("domain"))
    targets = {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}
    got = mixing.mix(docs, tags, targets).rates.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert sum(r.domain == r.lang for r in got) / len(got) > 0.97
    totals = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in sorted(targets)])
    assert np.abs(totals / totals.sum() - 0.25).max() < 1e-3
    copied = np.array([sum(r.copies * r.n_tokens * r[f"p_{d}"] for r in got) for d in sorted(targets)])
    assert np.abs(copied / copied.sum() - 0.25).max() < 0.06
    once = mixing.mix(docs, tags, targets, lowest=1.0).rates.collect()
    assert min(r.copies for r in once) >= 1


def test_edge_cases(spark):
    rows = [(1, "a b c", "x"), (2, None, "y"), (3, "", None), (4, "q " * 50000, "x"), (5, "d e f", "y"), (1, "a b c", "x"), (None, "a b", "y"), (6, "a", "unknown")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, domain string, rate int")
    got = mixing.mix(docs, docs, {"x": 1, "y": 2, "z": 1}).rates.collect()
    assert len(got) == len(rows)
    assert all(abs(r.p_x + r.p_y + r.p_z - 1) < 1e-9 and r.rate >= 0 and r.copies >= 0 for r in got)
    assert len({(r.rate, r.p_x) for r in got if r.doc_id == 1}) == 1
    assert mixing.mix(docs.limit(0), docs, {"x": 1}).rates.count() == 0
    assert mixing.mix(docs, docs.limit(0), {"x": 1, "y": 1}).rates.count() == len(rows)


def test_a_rare_domain_is_not_repeated_without_bound(spark):
    rnd = np.random.default_rng(7)
    word = lambda names: " ".join(rnd.choice(names, 20))
    rows = [(i, word(["the", "of", "house", "water"]), "en") for i in range(2000)] + [(9000 + i, word(["casa", "agua", "perro", "gato"]), "es") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    mix = mixing.mix(docs, docs, {"en": 1, "es": 1}, lowest=1.0, most=4.0)
    got = mix.rates.collect()
    assert max(r.copies for r in got) <= 4 and min(r.copies for r in got) >= 1 and sum(r.copies for r in got) <= 4 * len(got)
    assert mix.missed > 0.4 and mix.reached["es"] < 0.02 * mix.targets["es"]  # said, not hidden
    assert mixing.mix(docs, docs, {"en": 1, "es": 1}).missed < 1e-3


def test_temperature_makes_held_out_labels_likeliest(spark):
    """Words repeat in pairs, so naive Bayes counts everything twice; brute force over the grid finds the same temperature."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        kind = "xy"[rnd.integers(2)]
        told = rnd.choice([f"w{k}" for k in range(20)], 8, p=np.r_[np.full(10, 0.06 if kind == "x" else 0.04), np.full(10, 0.04 if kind == "x" else 0.06)])
        rows.append((i, " ".join(f"{w}a {w}b {w}c {w}d" for w in told), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.train(docs, docs, ["x", "y"])
    assert 2 <= model.temperature <= 16
    raw = {r.id: (r.s0, r.s1) for r in model.likelihoods(docs, "doc_id", "text").collect()}
    pick = docs.filter(F.pmod(F.xxhash64("text", F.lit("held out")), F.lit(mixing.HELD_OUT)) == 0).collect()

    def loss(t):
        out = 0
        for r in pick:
            z = [s / t + p for s, p in zip(raw[r.doc_id], model.priors, strict=True)]
            out += np.logaddexp(*z) - z["xy".index(r.domain)]
        return out

    assert model.temperature == min(mixing.TEMPERATURES, key=loss)


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixing.train(docs, docs.select("doc_id", F.col("lang").alias("domain")), ["de", "en"])
    plan = model.posteriors(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
