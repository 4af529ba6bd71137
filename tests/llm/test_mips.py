import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mips

SF = "/root/testdata/sf0.01"


def brute(rows, asks, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if asks(q):
            scored = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in good if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_whole_table(spark, block):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in mips.search(df, F.col("vec_id") % 50 == 0, block=block).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [3.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [9.0, 9.0]), (50, [-1.0, -2.0]), (51, [1e30, -1e30]), (100, [1e25, 1e25])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    asks = (F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in mips.search(df, asks).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert mips.search(df.limit(0), asks).count() == 0
    assert mips.search(df.filter("vec_id = 1"), asks).count() == 0


def over(x, ids, q, order, head, size=512):
    """A search of rows `q` over chunks of `order`."""
    rotation, unit = np.linalg.svd(x.T @ x)[0], float(np.abs(x).max())
    least = mips.first_least(ids[q], x[q], (ids[head], x[head]), 5, unit, 1)
    task = mips.Search(ids[q], x[q], least, 5, rotation, unit, 1)
    for i in range(0, len(order), size):
        task.take(ids[order[i : i + size]], x[order[i : i + size]])
    return task


def wanted(x, ids, q):
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    return sorted((i, int(ids[j]), int(s[i, j])) for i in range(len(q)) for j in np.lexsort((ids, -s[i]))[:5])


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 24)) * rng.pareto(2, size=(4000, 1)) * 50)
    ids, q = np.arange(len(x)), np.arange(0, 4000, 50)
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    task = over(x, ids, q, order, order[:512])
    assert task.computed < len(q) * len(x) / 2
    assert sorted(task.results()) == wanted(x, ids, q)


def test_longer_vectors_after_a_hopeless_chunk():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(2000, 8)) * 100)
    x[1000:] *= 50
    ids, q = np.arange(len(x)), np.arange(0, 2000, 40)
    task = over(x, ids, q, ids, ids[1000:1256], 250)  # the short half comes first
    assert sorted(task.results()) == wanted(x, ids, q)


@pytest.mark.parametrize("size", [1e150, 1e200, 1.7e308])
def test_large_finite_components(spark, size):
    rows = [(0, [size, 1.0]), (1, [-size, size / 2]), (2, [size, -size]), (50, [size, size]), (51, [0.25, 3.0]), (100, [1.0, 2.0]), (101, [5e-324, -5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in mips.search(df, F.col("vec_id") % 50 == 0).collect())
    exact = [(i, [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for a, v in exact:
        if a % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), b) for b, w in exact if b != a)
            want += [(a, rank, b, -s) for rank, (s, b) in enumerate(scored[:5], 1)]
    assert got == sorted(want)


def test_plan_does_not_grow_with_the_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2100, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    size = lambda found: len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    many = mips.search(df, F.col("vec_id") < 2050, block=1, partitions=4)
    assert size(many) == size(mips.search(df, F.col("vec_id") < 1, block=1, partitions=4))
    got = {}
    for r in many.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    x = np.floor(np.array([v for _, v in rows]) * 256)
    want = wanted(x, np.arange(len(x)), np.arange(2050))
    assert sorted((q, i, s) for q, hits in got.items() for _, i, s in hits) == want


def test_more_files_than_cores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)) * 0.5
    far = np.eye(8)[rng.integers(0, 8, 3000)] * (100 + np.arange(3000) / 10)[:, None]  # longer, but in smaller files, so tasks read them last
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[x, far])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # one task reads all files
    try:
        got = sorted(tuple(r) for r in mips.search(df, F.col("vec_id") % 500 == 0, partitions=20).collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == brute(rows, lambda i: i % 500 == 0)
