"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are ranged by descending length into written ranges.  Queries are rows too: they
are dealt into blocks of about `block`, and each block meets the ranges that it can
need, one task at a time, so neither side passes through the driver and the plan is
the same for any number of queries.  Within a range, rows come in chunks of descending
length.  A query leaves out a chunk when its length times the chunk's greatest length
can't reach its k-th best score so far.  For the rest, inner products over the first
dimensions of an SVD rotation plus the product of the residual lengths
(Cauchy-Schwarz) bound each score; only pairs whose bound reaches the k-th best are
computed, exactly, on whole numbers.  The k-th best starts from the longest vectors
of the whole table.

Bounds are taken on scaled vectors (queries by their own greatest component, all others
by the table's), so no length overflows; a bound that isn't finite rules nothing out.
The rotation is fitted on a bounded sample; it affects speed only.

Vectors that are null, or hold null or non-finite components, and rows without an
id take no part; shorter vectors count as padded with zeros; an empty vector
scores 0.  Equal scores go to the smaller id.  Rows of the query's own id are not
its candidates; other repeated rows are candidates each, and repeated queries are
answered each.  Scores beyond 64 bits saturate.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import durable

#: Rows of the sample that the rotation is fitted on, and of the longest vectors that give the first thresholds.
SAMPLE, HEAD = 2048, 1024
#: Vectors of a chunk; dimensions of the partial sums.
CHUNK, PART = 512, 16
LIMIT = 2**63 - 1
#: Shares of the lengths' product by which computed bounds and scores may be off.
SLACK = 1e-9


def floored(vectors: list, dims: int, scale: int = 256) -> np.ndarray:
    """floor(scale * x) / scale of every component, padded with zeros; exact for a `scale` that is a power of two.

    Doubles from 2**53 / scale on are whole multiples already, so nothing overflows.
    """
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        x = np.asarray(v, dtype=np.float64)
        small = np.abs(x) < 2.0**53 / scale
        row[: len(x)] = np.where(small, np.floor(np.where(small, x, 0.0) * scale) / scale, x)
    return out


def products(q: np.ndarray, c: np.ndarray, scale: int = 256) -> np.ndarray:
    """All inner products of floored vectors times the squared scale, as whole numbers; beyond 64 bits they saturate."""
    most = lambda x: float(np.abs(x).max()) * scale if x.size else 0.0
    if most(q) * most(c) * max(1, q.shape[1]) < 2**53:  # float64 holds all sums exactly
        return ((q * scale) @ (c * scale).T).astype(np.int64)
    whole = np.frompyfunc(lambda x: int(x * scale) if abs(x) < 2**53 else int(x) * scale, 1, 1)
    return np.clip(whole(q) @ whole(c).T, -LIMIT - 1, LIMIT).astype(np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x, axis=1)


class Search:
    """A block of queries with their k best so far, over candidates whose components are `unit` at most."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int, rotation: np.ndarray, unit: float, scale: int = 256):
        self.ids, self.vectors, self.k, self.rotation, self.unit, self.scale = ids, vectors, k, rotation, unit, scale
        self.scaled, self.own = scaled(vectors)
        self.norms = lengths(self.scaled)
        turned = self.scaled @ rotation
        self.part, self.rest = turned[:, :PART], lengths(turned[:, PART:])
        self.least = least.copy()  # below the k-th best scaled score of each query
        n = len(ids)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]  # scores, ids
        self.computed = 0
        with np.errstate(over="ignore"):  # scores that saturate tie, so none of them may be left out
            self.top = LIMIT / (float(scale) ** 2 * self.own * unit) * (1 - SLACK)

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Look at a chunk of candidates; any order is right, descending length is the fastest."""
        scaled_c = vectors / self.unit
        norms = lengths(scaled_c)
        live = np.flatnonzero(~(self.norms * norms.max() * (1 + SLACK) < self.least))
        if not len(live):
            return
        turned = scaled_c @ self.rotation
        part, rest = turned[:, :PART], lengths(turned[:, PART:])
        for at in range(0, len(live), 256):
            q = live[at : at + 256]
            slack = SLACK * np.outer(self.norms[q], norms)
            bound = self.part[q] @ part.T + np.outer(self.rest[q], rest) + slack
            possible = ~(bound < self.least[q, None]) & (ids[None, :] != self.ids[q, None])
            rows, cols = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
            if not len(rows):
                continue
            scores = products(self.vectors[q[rows]], vectors[cols], self.scale)
            near = self.scaled[q[rows]] @ scaled_c[cols].T - slack[np.ix_(rows, cols)]
            self.computed += scores.size
            possible = possible[np.ix_(rows, cols)] & ~(near + 2 * slack[np.ix_(rows, cols)] < self.least[q[rows], None])
            for r in np.flatnonzero(possible.any(axis=1)):
                self.keep(q[rows[r]], scores[r, possible[r]], ids[cols][possible[r]], near[r, possible[r]])

    def keep(self, i: int, scores: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        s, d = np.r_[self.best[i][0], scores], np.r_[self.best[i][1], ids]
        order = np.lexsort((d, -np.maximum(s, -LIMIT)))[: self.k]
        if (s == -LIMIT - 1).any():
            order = np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), d[j]))[: self.k])
        self.best[i] = s[order], d[order]
        if len(near) >= self.k:  # k of this chunk reach so much
            found = min(float(np.partition(near, -self.k)[-self.k]), float(self.top[i]))
            if found > -self.top[i]:
                self.least[i] = max(self.least[i], found)

    def results(self):
        for i, (s, d) in enumerate(self.best):
            for score, name in zip(s, d, strict=True):
                yield i, int(name), int(score)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their greatest absolute component, and that component (1 for zeros)."""
    own = np.abs(vectors).max(axis=1) if vectors.size else np.zeros(len(vectors))
    own = np.where(own > 0, own, 1.0)
    return vectors / own[:, None], own


def first_least(ids: np.ndarray, vectors: np.ndarray, head: tuple[np.ndarray, np.ndarray], k: int, unit: float, scale: int = 256) -> np.ndarray:
    """Lower bounds of the queries' k-th best scaled scores, from a head of candidates."""
    least = np.full(len(ids), -np.inf)
    if len(head[0]) > k:
        x, own = scaled(vectors)
        c = head[1] / unit
        near = x @ c.T - SLACK * np.outer(lengths(x), lengths(c))
        near[ids[:, None] == head[0][None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k]
        with np.errstate(over="ignore"):
            top = LIMIT / (float(scale) ** 2 * own * unit) * (1 - SLACK)
        least = np.where(least > -top, np.minimum(least, top), -np.inf)
    return least


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in column), dtype="<f8").reshape(-1, dims)


def search(df: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 4096, partitions: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the `k` best of all rows for each row where `queries` holds."""
    spark = df.sparkSession
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    finite = ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.filter(sound).filter(F.coalesce(finite, F.lit(True)))
    base = good.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    greatest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    told = base.agg(F.max(F.size("x")).alias("dims"), F.max(greatest).alias("most"), F.sum(F.col("asks").cast("long")).alias("asked")).first()
    dims, unit, blocks = max(1, told["dims"] or 1), float(told["most"] or 1.0) + 1.0 / scale, -(-(told["asked"] or 0) // block)
    unit = min(unit, float(np.finfo(np.float64).max))

    def pack(batches):
        for batch in batches:
            v = floored(batch["x"].tolist(), dims, scale)
            yield batch[["id", "asks"]].assign(v=[row.tobytes() for row in v], norm=lengths(v / unit))

    packed = base.mapInPandas(pack, "id bigint, asks boolean, v binary, norm double").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)))
    n = partitions or max(4, 2 * spark.sparkContext.defaultParallelism)
    ranged = packed.repartitionByRange(n, F.desc("norm"), "id", "salt").withColumn("r", F.spark_partition_id())
    table = durable(ranged.select("r", "id", "asks", "v", "norm"), "vectors")
    read = lambda rows: (np.array([r.id for r in rows], dtype=np.int64), _matrix([r.v for r in rows], dims))
    head = read(table.select("id", "v").orderBy(F.desc(table["norm"]), "id").limit(HEAD).collect())
    fitted = read(table.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect())[1] / unit
    rotation = np.linalg.svd(fitted.T @ fitted)[0] if len(fitted) else np.eye(dims)
    shared = spark.sparkContext.broadcast((rotation, head))  # bounded by HEAD rows

    def start(batches):
        for batch in batches:
            v = _matrix(batch["v"], dims)
            least = first_least(batch["id"].to_numpy(), v, shared.value[1], k, unit, scale)
            size = lengths(scaled(v)[0])
            need = np.where(least > 0, least * (1 - 2 * SLACK) / np.maximum(size, 1e-300), 0.0)
            yield batch.assign(least=least, need=need)

    # a query's number tells repeated queries apart; the table is written, so it stays the same
    asked = table.filter("asks").select("id", "v", F.monotonically_increasing_id().alias("q")).withColumn("b", F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))))
    asked = durable(asked.mapInPandas(start, "id bigint, v binary, q bigint, b bigint, least double, need double"), "queries")
    lowest = asked.groupBy("b").agg(F.min("need").alias("need"))
    reach = lowest.join(table.groupBy("r").agg(F.max("norm").alias("top")), F.col("top") * (1 + SLACK) >= F.col("need")).select("b", "r")  # a row a block and range
    reach = durable(reach, "reach")
    ask = asked.join(reach, "b").select("b", "r", F.lit(0).alias("kind"), F.lit(0.0).alias("norm"), "id", "v", "q", "least")
    look = table.join(reach, "r").select("b", "r", F.lit(1).alias("kind"), "norm", "id", "v", F.lit(0).cast("bigint").alias("q"), F.lit(0.0).alias("least"))
    met = ask.unionByName(look).repartition("b", "r").sortWithinPartitions("b", "r", "kind", F.desc("norm"))

    def run(batches):
        import pandas as pd

        now, held, task = None, [], None

        def done():
            got = list(task.results()) if task is not None else []
            if got:
                rows, names, scores = zip(*got, strict=True)
                at = list(rows)
                yield pd.DataFrame({"q": numbers[at], "query_id": task.ids[at], "id": names, "score": scores})

        numbers = np.zeros(0, np.int64)
        for batch in batches:
            key = batch["b"].to_numpy() * (1 << 32) + batch["r"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (batch["kind"].to_numpy()[1:] != batch["kind"].to_numpy()[:-1])]) if len(batch) else []
            for a, z in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.iloc[a:z]
                if key[a] != now:
                    yield from done()
                    now, held, task = key[a], [], None
                if part["kind"].iloc[0] == 0:
                    held.append(part)
                    continue
                if task is None:
                    if not held:
                        continue
                    own = pd.concat(held)
                    numbers, held = own["q"].to_numpy(), []
                    task = Search(own["id"].to_numpy(), _matrix(own["v"], dims), own["least"].to_numpy(), k, shared.value[0], unit, scale)
                for i in range(0, len(part), CHUNK):
                    chunk = part.iloc[i : i + CHUNK]
                    task.take(chunk["id"].to_numpy(), _matrix(chunk["v"], dims))
        yield from done()

    found = met.mapInPandas(run, "q bigint, query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
