"""A corpus pipeline: five stages that each apply one training-data operator.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept,
and returns a DataFrame; :func:`run` writes each result as Parquet in the shared
folder and rereads it for the next.  All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, setjoin, toxicity
from tessella.llm.entries import MIX_TARGETS, labelled_languages, vocabulary
from tessella.llm.shared import documents, durable, let_go


#: Most uses of a document in the mix, and so the most that mixing multiplies any table by.
MOST_COPIES = 4


def _beside(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have, whatever columns they came with."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letter, or too far from every language.

    Columns of any name stay as they are; of an empty table nothing is kept.
    """
    name = _beside(docs, "_language")
    found = langid.identify(docs, langid.fit(docs), out_col=name)
    return found.filter(~F.col(f"{name}.rejected")).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.5 or more.

    Columns of any name stay as they are; without labels nothing is dropped.
    """
    name = _beside(docs, "_toxicity")
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out_col=name).filter(F.col(name) < 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: of the smallest id, the least text.

    Rows of one id with different texts are different documents, and belong to the
    group of their own text.  Texts without a word link with nothing: one row stays for
    each id.  Rows without an id can't be told apart from others and stay.  Columns of any
    name stay as they are.
    """
    mark, rank = _beside(docs, "_mark"), _beside(docs, "_rank")
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = setjoin.grouped(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL")
    wordless = groups.filter("component IS NULL").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    least = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*")
    first = durable(least.unionByName(wordless).distinct().select(F.col("doc_id").alias("_first"), F.col("mark").alias("_first_mark")), "kept")
    one = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"])))
    stays = named.join(first, (F.col("doc_id") == F.col("_first")) & (F.col(mark) == F.col("_first_mark")), "left_semi").withColumn(rank, one)
    return stays.filter(F.col(rank) == 1).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the languages' tokens meet their target weights; every document is used once to `MOST_COPIES` times.

    Where a language is too rare for that, its target is missed: the mix has
    `MOST_COPIES` times the table at most.  Columns of any name stay as they are; an
    empty table stays empty.
    """
    copies, use = _beside(docs, "_copies"), _beside(docs, "_use")
    mix = mixing.mix(docs, labelled_languages(spark, sf_dir), MIX_TARGETS, lowest=1.0, most=float(MOST_COPIES))
    rates = mix.rates.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias(copies))
    used = docs.join(rates, "doc_id", "left")
    times = F.greatest(F.coalesce(F.col(copies), F.lit(1)), F.lit(1))
    return used.withColumn(use, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, vocabulary(), remember=500_000)  # executors still hold what the stages before have used


STAGES = [
    ("language identification", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing to target weights", mix_languages),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifiers nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.split()[0])
        let_go(spark)
    return docs
