"""Full-text and vector search.

BM25 statistics need one pass over the whole column: the number of texts, their mean
length, and how many hold each term of the query.  The score is then an expression
on the row, so a search scans twice, shuffles nothing but partial aggregates and
ends in a bounded heap.  With postings (:func:`postings`), which are sorted by term,
a search reads the row groups of its terms only.

Nearest neighbours are exact by default.  :class:`Cells` is an optional index: k-means
cells fitted on a bounded sample, every row assigned to a cell, the nearest cells
scanned, and the result ranked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vector as V


@dataclass(frozen=True)
class CorpusStats:
    docs: int
    mean_length: float
    docs_with: dict[str, int]


def corpus_stats(df: DataFrame, column: str, query: str) -> CorpusStats:
    """Statistics of a column for the terms of a query; texts without tokens count."""
    terms = list(T.query_terms(query))
    text = F.col(column)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.avg(T.length(text)), F.lit(0.0)).alias("mean"), *[F.count_if(T.matches(text, t)).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    return CorpusStats(row["n"], float(row["mean"]), {t: row[f"d{i}"] for i, t in enumerate(terms)})


def bm25(column: Column, query: str, stats: CorpusStats) -> Column:
    """BM25 of a text for a query; 0 without a hit.  A term counts as often as the query has it.

    Counts are expressions that Spark shares within a row, and no list of tokens is made.
    """
    score: Column = F.lit(0.0)
    for term, times in T.query_terms(query).items():
        tf = T.occurrences(column, term).cast("double")
        score = score + times * T.bm25_term(tf, T.length(column), F.lit(stats.mean_length), F.lit(stats.docs), F.lit(stats.docs_with[term]))
    return score


def bm25_top(df: DataFrame, id_col: str, column: str, query: str, k: int) -> DataFrame:
    """id and score of the best `k` texts with a hit, by score and then id."""
    stats = corpus_stats(df, column, query)
    hits = df.filter(T.matches(F.col(column), query)).select(id_col, bm25(F.col(column), query, stats).alias("score"))
    return hits.orderBy(F.desc("score"), id_col).limit(k)


def postings(df: DataFrame, id_col: str, column: str, *more: str) -> DataFrame:
    """(term, id, length, tf) of every token of a column, ranged and sorted by term; `more` columns of the rows are kept."""
    told = df.select(F.col(id_col).alias("id"), *more, T.tokens(F.col(f"`{column}`")).alias("t"))
    rows = told.select("id", *more, F.size("t").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy("term", "id", *more, "length").agg(F.count("*").alias("tf")).repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def scores(index: DataFrame, docs: int, mean_length: float, query: str) -> DataFrame:
    """id and score of every text with a hit, from stored postings; the terms are pushed into the scan.

    The terms' parts are added in the order of the query, so scores equal those of :func:`bm25` to the last bit.
    """
    terms = T.query_terms(query)
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = index.filter(F.col("term").isin(*terms))
    found = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term
    counted = hits.groupBy("id").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)])
    score: Column = F.lit(0.0)
    for i, (term, times) in enumerate(terms.items()):
        tf = F.coalesce(F.col(f"tf{i}"), F.lit(0)).cast("double")
        score = score + times * T.bm25_term(tf, F.col("length"), F.lit(mean_length), F.lit(docs), F.lit(found.get(term, 0)))
    return counted.select("id", score.alias("score"))


def bm25_from_postings(index: DataFrame, docs: int, mean_length: float, query: str, k: int) -> DataFrame:
    """id and score of the best `k`, from stored postings."""
    return scores(index, docs, mean_length, query).orderBy(F.desc("score"), "id").limit(k)


class StoredText:
    """Postings and statistics of a column, written below a path: a search reads the row groups of its terms only."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = spark.read.parquet(f"{path}/postings")
        self.docs, self.mean_length = spark.read.parquet(f"{path}/stats").first()

    @classmethod
    def build(cls, df: DataFrame, id_col: str, column: str, path: str) -> StoredText:
        postings(df, id_col, column).write.parquet(f"{path}/postings")
        df.agg(F.count("*").alias("docs"), F.coalesce(F.avg(T.length(F.col(column))), F.lit(0.0)).alias("mean")).write.parquet(f"{path}/stats")
        return cls(df.sparkSession, path)

    def top(self, query: str, k: int) -> DataFrame:
        """id and score of the best `k` texts with a hit, by score and then id."""
        return bm25_from_postings(self.index, self.docs, self.mean_length, query, k)


def nearest(df: DataFrame, id_col: str, column: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """id and distance of the `k` nearest vectors, exactly; ties by id.  Null vectors are left out."""
    target = F.array(*[F.lit(float(x)) for x in query])
    told = df.filter(F.col(column).isNotNull()).select(id_col, V.METRICS[metric](F.col(column), target).alias("distance"))
    return told.orderBy("distance", id_col).limit(k)


class Cells:
    """Approximate nearest neighbours by k-means cells.

    `fit` draws a sample of about `sample` vectors by a hash of the id, and nothing
    else comes to the driver; `assign` adds a `cell` column to every row, for a
    table that is written with ``partitionBy("cell")`` or sorted by cell, so a search
    reads the probed cells only.
    """

    def __init__(self, centres: np.ndarray, metric: str):
        self.centres, self.metric = centres, metric

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, column: str, *, cells: int = 16, metric: str = "l2", sample: int = 4096) -> Cells:
        good = df.filter(F.col(column).isNotNull())
        share = min(1.0, sample / max(1, good.count()))
        draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
        rows = good.filter(draw < share).select(id_col, F.col(column).cast("array<double>").alias("v")).collect()
        rows.sort(key=lambda r: r[0])
        x = np.array([r["v"] for r in rows]) if rows else np.zeros((1, 1))
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(15):
            near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        return cls(c, metric)

    def _distances(self, vector: Column) -> Column:
        if self.metric == "cosine":
            size = F.sqrt(V.dot(vector, vector))
            vector = F.transform(vector.cast("array<double>"), lambda x: x / F.when(size == 0, 1.0).otherwise(size))
        return F.array(*[V.l2(vector, F.array(*[F.lit(float(x)) for x in c])) for c in self.centres])

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        """All rows with the number of their nearest cell; null for null vectors."""
        told = df.withColumn("_near", F.when(F.col(column).isNotNull(), self._distances(F.col(column))))
        return told.withColumn("cell", (F.array_position("_near", F.array_min("_near")) - 1).cast("int")).drop("_near")

    def probe(self, query: list[float], probes: int) -> list[int]:
        q = np.array(query, dtype=float)
        if self.metric == "cosine":
            q = q / max(np.linalg.norm(q), 1e-12)
        order = (self.centres @ q).argsort()[::-1] if self.metric == "dot" else ((self.centres - q) ** 2).sum(axis=1).argsort()
        return [int(i) for i in order[:probes]]

    def search(self, assigned: DataFrame, id_col: str, column: str, query: list[float], k: int, probes: int = 13) -> DataFrame:
        """The nearest `k` of the probed cells, ranked exactly."""
        return nearest(assigned.filter(F.col("cell").isin(*self.probe(query, probes))), id_col, column, query, k, self.metric)
