"""Mixing to target weights with soft memberships.

DataFrame operations only.  A naive Bayes classifier over hashed words, trained on a
bounded sample of a labelled table, gives each document a posterior p over domains.
Naive Bayes takes words for independent and so is too sure: its log likelihoods are
divided by a temperature, the one that makes held-out labels of the sample likeliest.
Each document gets a rate r from `lowest` to `most`, the number of times it is to be used,
such that the expected tokens of each domain, A_d = sum of r n p_d over all documents,
come as near as can be to target totals T_d in least squares.

The rates are found by projected gradients.  Distances between rates are weighted
by tokens and residuals by W, the inverse of the sum of n p p', so a step is
r := min(most, max(lowest, r - p W (A - T))), where the sum goes over rows that can still move
if that gains more; each step needs one aggregate of a few numbers over
the table of posteriors.  A rate is the fold of all steps so far, so no state is kept
for the documents, and a lost executor costs no more than its tasks.  Targets may be out
of reach (`lowest`, `most`, a domain without tokens), or steps may end early: the totals that
the rates reach are returned beside the targets.

Null and empty texts have no tokens, the prior as their posterior, and rates like any
other.  Domains without a labelled document have the least prior.  Repeated rows get
equal posteriors and rates.  Rows without a domain or with one that has no target
aren't learnt from.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import ascii_lower, bounded_sample, durable, let_go

#: Buckets that words are hashed to.
BUCKETS = 4096
#: Temperatures among which the posteriors are calibrated; one document of so many of the sample is held out for that.
TEMPERATURES = tuple(2.0 ** (k / 2) for k in range(21))
HELD_OUT = 5


def tokens(text: Column) -> Column:
    """Words of a text in lower case, parted by all ASCII that is neither letter nor digit; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Log likelihoods by bucket and domain, a table of at most `BUCKETS` rows, the domains' log priors, and the temperature."""

    def __init__(self, domains: list[str], table: DataFrame, priors: list[float], blank: list[float], temperature: float = 1.0):
        self.domains, self.table, self.priors, self.blank, self.temperature = domains, table, priors, blank, temperature

    def likelihoods(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id, n_tokens and s0, s1, ... (log likelihoods in the order of domains) for every row, from the whole text."""
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
        rows = rows.select("row", "id", F.size("w").cast("long").alias("n_tokens"), F.explode_outer(F.array_distinct("w")).alias("word"))
        met = rows.withColumn("bucket", _bucket(F.col("word"))).join(F.broadcast(self.table), "bucket", "left")
        logs = [F.sum(F.when(F.col("word").isNull(), 0.0).otherwise(F.coalesce(F.col(f"l{k}"), F.lit(self.blank[k])))).alias(f"s{k}") for k in range(len(self.domains))]
        return met.groupBy("row", "id", "n_tokens").agg(*logs)

    def logits(self, temperature: float) -> list[Column]:
        return [F.col(f"s{k}") / float(temperature) + F.lit(self.priors[k]) for k in range(len(self.domains))]

    def posteriors(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id, n_tokens and p (array in the order of domains) for every row, from the whole text."""
        score = self.logits(self.temperature)
        top = F.greatest(*score) if len(score) > 1 else score[0]
        found = self.likelihoods(docs, id_col, text_col).withColumn("e", F.array(*[F.exp(s - top) for s in score]))
        total = reduce(lambda a, b: a + b, [F.get("e", F.lit(k)) for k in range(len(self.domains))])
        return found.select("id", "n_tokens", F.transform("e", lambda e: e / total).alias("p"))

    def calibrated(self, held: DataFrame) -> Classifier:
        """With the temperature that makes the domains of (domain, text) rows likeliest; as it is if there are none."""
        told = self.likelihoods(held, "domain", "text")

        def loss(t: float) -> Column:
            z = self.logits(t)
            top = F.greatest(*z) if len(z) > 1 else z[0]
            own = reduce(lambda c, k: F.when(F.col("id") == self.domains[k], z[k]).otherwise(c), range(len(z)), F.lit(0.0))
            return F.sum(top + F.log(reduce(lambda a, b: a + b, [F.exp(x - top) for x in z])) - own)

        row = told.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
        losses = [row[f"t{i}"] for i in range(len(TEMPERATURES))]
        best = 1.0 if losses[0] is None else TEMPERATURES[int(np.argmin(losses))]
        return Classifier(self.domains, self.table, self.priors, self.blank, best)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample_docs: int = 4000, sample_bytes: int = 64_000_000, smoothing: float = 0.5) -> Classifier:
    """Fit on a sample of labelled documents, evenly over the domains: at most `sample_docs` rows and `sample_bytes` bytes of whole texts."""
    tags = labelled.filter(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("kind"))
    each = max(1, sample_docs // len(domains))
    counts, drawn = bounded_sample(tags.withColumn("text", F.lit(None).cast("string")), each, 0, "domain labels")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = text.join(F.broadcast(drawn.select("id", "kind")), "id")  # at most sample_docs rows are broadcast
    _, sample = bounded_sample(found.select("id", "kind", "text"), each, sample_bytes // len(domains), "domain sample")
    picked = durable(sample.select(F.col("kind").alias("domain"), "text", (F.pmod(F.xxhash64("text", F.lit("held out")), F.lit(HELD_OUT)) == 0).alias("held")), "domain-sample")
    learnt = picked.filter("NOT held")
    words = learnt.select("domain", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    words = durable(words, "domain-words")
    totals = {r.domain: r.n for r in words.groupBy("domain").agg(F.sum("n").alias("n")).collect()}  # a row a domain
    mass = [totals.get(d, 0) + smoothing * BUCKETS for d in domains]
    table = words.groupBy("bucket").agg(*[
        F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + smoothing) / mass[k]).alias(f"l{k}") for k, d in enumerate(domains)
    ])
    known = sum(counts.values())
    priors = [math.log((counts.get(d, 0) + 0.5) / (known + 0.5 * len(domains))) for d in domains]
    return Classifier(domains, durable(table, "domain-model"), priors, [math.log(smoothing / m) for m in mass]).calibrated(picked.filter("held"))


def rate_of(steps: list[np.ndarray], lowest: float, start: float = 1.0, most: float = math.inf) -> Column:
    """The rate of a row with posteriors `p` after all steps."""
    rate: Column = F.lit(float(start))
    for g in steps:
        move = reduce(lambda a, b: a + b, [F.get("p", F.lit(k)) * float(x) for k, x in enumerate(g)])
        rate = F.greatest(F.lit(float(lowest)), rate - move)
        if most < math.inf:
            rate = F.least(F.lit(float(most)), rate)
    return rate


def fit_rates(table: DataFrame, weights: list[float], *, lowest: float = 0.0, most: float = math.inf, total: float | None = None, most_steps: int = 12, close: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradient steps for rows of (n_tokens, p); the domains' totals that they reach, and the targets.

    `total` is the number of tokens that the mix is to have.  By default it is that
    of the table; with `lowest` of 1 or more it is as many as it takes to use
    nothing less than once, but no more than `most` times the table.
    """
    size = len(weights)
    p = [F.get("p", F.lit(k)) for k in range(size)]
    n = F.col("n_tokens").cast("double")
    first = table.agg(*[F.sum(n * p[k]).alias(f"a{k}") for k in range(size)], *[F.sum(n * p[j] * p[k]).alias(f"m{j}_{k}") for j in range(size) for k in range(j, size)]).first()
    have = np.array([first[f"a{k}"] or 0.0 for k in range(size)])
    gram = np.array([[first[f"m{min(j, k)}_{max(j, k)}"] or 0.0 for k in range(size)] for j in range(size)])
    w = np.array(weights) / sum(weights)
    if total is None:
        total = float((have / w).max()) if lowest >= 1 else float(have.sum())
        total = min(total, most * float(have.sum())) if have.sum() else 0.0
    target = w * total
    metric = full = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    reached = have
    for _ in range(most_steps):
        gap = reached - target
        if np.abs(gap).sum() <= close * max(total, 1.0):
            break
        step = metric @ gap
        r = rate_of([*steps, step], lowest, most=most)
        free = F.when((r > lowest) & (r < most), n).otherwise(0.0)
        row = table.agg(
            *[F.sum(r * n * p[k]).alias(f"a{k}") for k in range(size)], *[F.sum(free * p[j] * p[k]).alias(f"m{j}_{k}") for j in range(size) for k in range(j, size)]
        ).first()
        now = np.array([row[f"a{k}"] or 0.0 for k in range(size)])
        if (now - target) @ full @ (now - target) > (1 - 1e-9) * (gap @ full @ gap):
            if metric is full:  # a plain step no longer gains anything
                break
            metric = full
            continue
        steps.append(step)
        reached = now
        # the next step uses the metric of the rows that can still move
        metric = np.linalg.pinv(np.array([[row[f"m{min(j, k)}_{max(j, k)}"] or 0.0 for k in range(size)] for j in range(size)]), rcond=1e-9, hermitian=True)
    return steps, reached, target


@dataclass
class Mix:
    """Rates of all rows, and by domain the tokens that were aimed at and those that the rates reach."""

    rates: DataFrame
    targets: dict[str, float]
    reached: dict[str, float]
    temperature: float

    @property
    def missed(self) -> float:
        """Share of the tokens that are in the wrong domain: 0 where the targets' weights are met."""
        aim, got = sum(self.targets.values()), sum(self.reached.values())
        return sum(abs(self.reached[d] / got - self.targets[d] / aim) for d in self.targets) / 2 if aim and got else 0.0


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", lowest: float = 0.0, most: float = math.inf, total: float | None = None, sample_docs: int = 4000) -> Mix:
    """Rates: `id_col`, n_tokens, domain (likeliest; the first at a tie), p_<domain>, rate and copies for every row of `docs`.

    `copies` is the rate rounded down, and up with the rate's fraction as its
    probability, by a hash of the id; `most` bounds it.
    """
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets need a positive weight for each domain")
    domains = sorted(targets)
    model = train(docs, labelled, domains, id_col=id_col, text_col=text_col, domain_col=domain_col, sample_docs=sample_docs)
    table = durable(model.posteriors(docs, id_col, text_col), "posteriors")
    let_go(docs.sparkSession)
    steps, reached, aim = fit_rates(table, [targets[d] for d in domains], lowest=lowest, most=most, total=total)
    let_go(docs.sparkSession)
    draw = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rated = table.withColumn("rate", rate_of(steps, lowest, most=most))
    likeliest = F.get(F.array(*[F.lit(d) for d in domains]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rates = rated.select(F.col("id").alias(id_col), "n_tokens", likeliest.alias("domain"), *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], "rate", copies.alias("copies"))
    return Mix(rates, dict(zip(domains, aim.tolist(), strict=True)), dict(zip(domains, reached.tolist(), strict=True)), model.temperature)
