"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import durable, let_go


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is the least node of its component.

    Alternates two star contractions until nothing changes.  Large star: each node
    links its larger neighbours to the least node it sees.  Small star: each node
    links its smaller neighbours, and itself, to the least of them.  Both combine
    before they shuffle, neither gathers a neighbourhood in one task, and each
    round is a written table.
    """
    work = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return work.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(work.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state
        let_go(edges.sparkSession)
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        work = durable(lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
