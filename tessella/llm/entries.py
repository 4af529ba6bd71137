"""The thin ``opN_<name>`` queries: production parameters, whole tables.

Every query takes ``(spark, sf_dir)``; ``SQL`` has the DuckDB equivalent where
SQL can express one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, licenses, media, mips, mixing, oracles, setjoin, token_file, toxicity, urls
from tessella.llm.shared import documents, fold


def vocabulary() -> str:
    """The byte-level BPE vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text."""
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license texts in every whole text."""
    return licenses.summary(licenses.scan(documents(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; learnt from labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), learn_from=fold("doc_id") != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Rules of the url query.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and path templates over the url of every page."""
    return urls.judge(documents(spark, sf_dir, "pages"), urls.parse_rules(URL_RULES))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    found = mips.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learnt from documents outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, learn_from=fold("doc_id") != 0)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return setjoin.join(documents(spark, sf_dir))


def op8_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image in tar shards, read the stored bytes back, and return digests and features."""
    told = media.describe(media.store(documents(spark, sf_dir)))
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "channels")


#: Target shares of the languages' tokens.
MIX_TARGETS = {"en": 0.50, "de": 0.17, "fr": 0.18, "es": 0.15}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the languages of the documents that the table of labels covers."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("domain"))
    return documents(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id")


def op9_mix_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which all documents are to be used, so that languages have their target shares of tokens; and the totals aimed at and reached."""
    mix = mixing.mix(documents(spark, sf_dir), labelled_languages(spark, sf_dir), MIX_TARGETS)
    totals = [F.lit(x[d]).alias(f"{name}_{d}") for name, x in (("target", mix.targets), ("reached", mix.reached)) for d in sorted(MIX_TARGETS)]
    return mix.rates.select("*", *totals)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of all documents with Elias-Fano boundaries and read the files back."""
    return token_file.read(token_file.write(documents(spark, sf_dir), vocabulary(), end_id=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_top_k": op4_top_k,
    "op5_language_id": op5_language_id,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_media_store": op8_media_store,
    "op9_mix_rates": op9_mix_rates,
    "op10_token_files": op10_token_files,
}

SQL: dict[str, str] = {
    "op1_license_scan": oracles.license_scan(),
    "op3_url_filter": oracles.url_filter(URL_RULES),
    "op4_top_k": """
        WITH sound AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), part AS (
            SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM sound
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, SUM(q.x * c.x) AS score
            FROM part q JOIN part c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
    """,
    "op7_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), part AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM part a JOIN part b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY ALL
    """,
}
