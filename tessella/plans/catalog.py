"""Named queries over the test tables, each with equivalent DuckDB SQL.

Most are SELECT statements of the dialect; the others call operators directly.
Floating-point sums are rounded on both sides, as their order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import json as J
from tessella.functions import text as TX
from tessella.functions import vector as V
from tessella.operators import relational, search
from tessella.plans.query import select
from tessella.sources.files import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str | None = None, **digits: int) -> None:
    """A SELECT of the dialect; DuckDB runs the same text unless it needs another."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = select(spark, folder, text)
        return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in df.columns])

    QUERIES[name] = run
    SQL[name] = oracle or text


def _op(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            SQL[name] = oracle
        return run

    return add


_sql(
    "flagship",
    "SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 1 ORDER BY total DESC LIMIT 5",
    "SELECT c_mktsegment, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 1 ORDER BY total DESC LIMIT 5",
    total=2,
)

# --- scans, projections and filters -----------------------------------------------

_sql("scan_all", "SELECT * FROM region")
_sql("scan_project", "SELECT n_nationkey, n_name AS nation FROM nation")
_sql("scan_alias", "SELECT n.n_name, n.n_regionkey AS region FROM nation AS n")
_sql("filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
_sql("filter_literal_first", "SELECT c_name FROM customer WHERE 7 = c_nationkey")
_sql("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 100500.5")
_sql("filter_not_equal", "SELECT n_name FROM nation WHERE n_regionkey <> 2")
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'R%g'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'r%g'")
_sql("filter_like_one", "SELECT p_partkey FROM part WHERE p_name LIKE '_ed w%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '_ed w%'")
_sql("filter_not_like", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%o%'", "SELECT p_partkey, p_type FROM part WHERE p_type NOT ILIKE '%o%'")
_sql("filter_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE 'eco%'")
_sql("filter_like_number", "SELECT p_partkey FROM part WHERE p_size LIKE '1_'", "SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) LIKE '1_'")
_sql("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sql("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_sql("filter_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, NULL)")
_sql("filter_is_null", "SELECT n_name FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9900 WHERE c_custkey IS NULL")
_sql("filter_is_not_null", "SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9900 WHERE c_custkey IS NOT NULL")
_sql("filter_logic", "SELECT s_suppkey FROM supplier WHERE NOT (s_nationkey = 3 OR s_acctbal < 0) AND s_suppkey % 2 = 1")
_sql("filter_truthy", "SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0")
_sql("filter_cross_type", "SELECT n_name FROM nation WHERE n_nationkey = '7'", "SELECT n_name FROM nation WHERE CAST(n_nationkey AS VARCHAR) = '7'")
_sql("arith_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 98000")
_sql("arith_whole", "SELECT p_partkey FROM part WHERE p_size / 7 = 3 AND -p_size + 50 > 20", "SELECT p_partkey FROM part WHERE p_size // 7 = 3 AND -p_size + 50 > 20")
_sql("concat_where", "SELECT p_partkey FROM part WHERE p_brand || '/' || p_size = 'Brand#2/11'", "SELECT p_partkey FROM part WHERE p_brand || '/' || CAST(p_size AS VARCHAR) = 'Brand#2/11'")

# --- order, limit, distinct ------------------------------------------------------------

_op("order_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(
    lambda spark, d: relational.top(parquet(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 20, descending=True, tie="o_orderkey")
)
_sql("order_key", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 15")
_sql("order_expr", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * 1000 - p_partkey / 100000 DESC LIMIT 12", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * 1000 - p_partkey // 100000 DESC, p_partkey LIMIT 12")
_sql("order_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 10")
_sql("limit_zero", "SELECT r_name FROM region LIMIT 0")
_sql("distinct_one", "SELECT DISTINCT l_returnflag FROM lineitem")
_sql("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql("distinct_join", "SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_op("distinct_in_order", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(p_size) NULLS FIRST, p_brand")(
    lambda spark, d: relational.distinct_in_order(parquet(spark, d, "part"), ["p_brand"], F.col("p_size"))
)
_sql("distinct_order", "SELECT DISTINCT l_linestatus FROM lineitem ORDER BY l_quantity DESC LIMIT 2", "SELECT l_linestatus FROM lineitem GROUP BY l_linestatus ORDER BY max(l_quantity) DESC, l_linestatus LIMIT 2")

# --- joins -------------------------------------------------------------------------------

_sql("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
_sql("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 5000")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_theta", "SELECT a.n_name AS one, b.n_name AS two FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_self", "SELECT a.p_partkey, b.p_partkey AS same_size FROM part AS a JOIN part AS b ON a.p_size = b.p_size AND a.p_partkey + 1 = b.p_partkey")
_sql("join_three", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_sql("join_anti_idiom", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 WHERE o_orderkey IS NULL")
_sql("join_using", "SELECT * FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
_sql("join_natural", "SELECT doc_id, quality FROM documents NATURAL JOIN labels")
_sql("join_natural_left", "SELECT * FROM documents NATURAL LEFT JOIN labels WHERE quality IS NULL")
_sql("join_natural_nothing_shared", "SELECT r_name, s_suppkey FROM region NATURAL JOIN supplier", "SELECT r_name, s_suppkey FROM region CROSS JOIN supplier")
_sql("join_full_using", "SELECT doc_id, toxic FROM labels FULL JOIN documents USING (doc_id)")
_op("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(
    lambda spark, d: relational.anti(parquet(spark, d, "customer").select("c_custkey"), parquet(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
)

# --- aggregates ----------------------------------------------------------------------------

_sql(
    "agg_all",
    "SELECT COUNT(*) AS n, COUNT(l_tax) AS taxed, SUM(l_quantity) AS q, AVG(l_discount) AS d, MIN(l_shipdate) AS first, MAX(l_returnflag) AS last FROM lineitem",
    "SELECT COUNT(*) AS n, COUNT(l_tax) AS taxed, round(SUM(l_quantity), 2) AS q, round(AVG(l_discount), 6) AS d, MIN(l_shipdate) AS first, MAX(l_returnflag) AS last FROM lineitem",
    q=2, d=6,
)
_sql("agg_names", "SELECT COUNT(*), COUNT(DISTINCT c_nationkey), MIN(customer.c_custkey) FROM customer", 'SELECT COUNT(*) AS "COUNT(*)", COUNT(DISTINCT c_nationkey) AS "COUNT(DISTINCT c_nationkey)", MIN(c_custkey) AS "MIN(customer.c_custkey)" FROM customer')
_sql("agg_empty", "SELECT COUNT(*) AS n, SUM(c_custkey) AS s, MAX(c_name) AS m FROM customer WHERE c_custkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(c_custkey) AS BIGINT) AS s, MAX(c_name) AS m FROM customer WHERE c_custkey < 0")
_sql("count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS customers FROM orders")
_sql("sum_whole", "SELECT SUM(p_size) AS s FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS s FROM part")
_sql("group_one", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
_sql(
    "group_multi",
    "SELECT l_returnflag, l_linestatus, SUM(l_extendedprice) AS price, AVG(l_quantity) AS quantity, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, round(SUM(l_extendedprice), 2) AS price, round(AVG(l_quantity), 6) AS quantity, COUNT(*) AS n FROM lineitem GROUP BY ALL",
    price=2, quantity=6,
)
_sql("group_many", "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey")
_sql("group_plain", "SELECT n_regionkey FROM nation GROUP BY n_regionkey")
_sql("group_order_agg", "SELECT user_id, COUNT(*) FROM events GROUP BY user_id HAVING COUNT(*) > 3 ORDER BY user_id LIMIT 40", 'SELECT user_id, COUNT(*) AS "COUNT(*)" FROM events GROUP BY user_id HAVING COUNT(*) > 3 ORDER BY user_id LIMIT 40')
_sql("having", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING n > 50")
_sql("having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) < 20000")
_sql("agg_join", "SELECT n.n_name, COUNT(*) AS n, COUNT(DISTINCT c.c_mktsegment) AS segments FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
_sql("agg_outer_join", "SELECT n_name, COUNT(*) AS rows_n, COUNT(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_name")
_sql("agg_distinct", "SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey")

# --- JSON, vectors, text ------------------------------------------------------------------------

_sql("json_where", "SELECT event_id FROM events WHERE json_extract(props, '$.k') = 69", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 69")
_op("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda spark, d: parquet(spark, d, "events").select("event_id", J.extract(F.col("props"), "$.k").alias("k")))
_op("json_type", "SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'real' END AS kind, CASE json_type(props) WHEN 'OBJECT' THEN 'object' END AS root FROM events")(
    lambda spark, d: parquet(spark, d, "events").select("event_id", J.kind(F.col("props"), "$.k").alias("kind"), J.kind(F.col("props")).alias("root"))
)
_op("json_keys", """SELECT event_id, CAST(to_json(json_keys(props)) AS VARCHAR) AS keys FROM events""")(lambda spark, d: parquet(spark, d, "events").select("event_id", J.object_keys(F.col("props")).alias("keys")))
_op("json_array_length", "SELECT event_id, CAST(json_array_length('[' || props || ',1]') AS BIGINT) AS n FROM events")(
    lambda spark, d: parquet(spark, d, "events").select("event_id", J.array_length(F.concat(F.lit("["), F.col("props"), F.lit(",1]"))).alias("n"))
)

_QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 40, 4) for i in range(64)]
_ORACLE_VECTOR = "CAST([" + ", ".join(map(str, _QUERY_VECTOR)) + "] AS DOUBLE[])"
_PARTS = f"SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest({_ORACLE_VECTOR}) AS y FROM embeddings"
for _name, _value in {
    "l2": "sqrt(sum((x - y) * (x - y)))",
    "cosine": "1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))",
    "dot": "-sum(x * y)",
}.items():
    _op(f"vec_{_name}", f"SELECT vec_id, round({_value}, 6) AS distance FROM ({_PARTS}) GROUP BY vec_id ORDER BY {_value}, vec_id LIMIT 10")(
        lambda spark, d, metric=_name: search.nearest(parquet(spark, d, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 10, metric).withColumn("distance", F.round("distance", 6))
    )
_sql(
    "vec_filter",
    "SELECT vec_id FROM embeddings WHERE label = 2 AND vec_distance_l2(embedding, [" + ", ".join(map(str, _QUERY_VECTOR)) + "]) < 1.4",
    f"SELECT vec_id FROM ({_PARTS}) JOIN embeddings USING (vec_id) WHERE label = 2 GROUP BY vec_id HAVING sqrt(sum((x - y) * (x - y))) < 1.4",
)

_TOKENS = "list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_TERMS = "the", "license", "apache"


def _bm25_sql(k: int | None) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))
    with_term = ", ".join(f"sum(CAST(f{i} > 0 AS INT)) AS d{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * (f{i} * 2.5) / (f{i} + 1.5 * (0.25 + 0.75 * dl / mean)) ELSE 0 END" for i in range(len(_TERMS)))
    return f"""
        WITH told AS (SELECT doc_id, {_TOKENS} AS t FROM documents), tf AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl, {counts} FROM told),
        stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {with_term} FROM tf)
        SELECT doc_id, round({score}, 6) AS score FROM tf, stats WHERE {" OR ".join(f"f{i} > 0" for i in range(len(_TERMS)))} ORDER BY {score} DESC, doc_id {f"LIMIT {k}" if k else ""}
    """


_sql("fts_match", "SELECT doc_id FROM documents WHERE fts_match(text, 'MIT apache')", f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS}, lambda t: t IN ('mit', 'apache'))) > 0")
_op("bm25_topk", _bm25_sql(10))(lambda spark, d: search.bm25_top(parquet(spark, d, "documents"), "doc_id", "text", " ".join(_TERMS), 10).withColumn("score", F.round("score", 6)))


@_op("bm25_postings", _bm25_sql(10))
def _from_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Over a stored index, which a session builds once for a folder."""
    key = spark.sparkContext.applicationId, folder
    if key not in _STORED:
        from tessella.sources.store import Store

        _STORED[key] = search.StoredText.build(parquet(spark, folder, "documents"), "doc_id", "text", Store(spark, None).new_folder("documents"))
    return _STORED[key].top(" ".join(_TERMS), 10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_STORED: dict[tuple[str, str], search.StoredText] = {}


@_op("tokens", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n FROM documents")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return parquet(spark, folder, "documents").select("doc_id", F.size(TX.tokens(F.col("text"))).cast("bigint").alias("n"))


@_op(
    "hybrid",
    _bm25_sql(None).replace("SELECT doc_id, round(", "SELECT doc_id, round(0.5 * (", 1).replace(", 6) AS score", ") + 0.5 * distance, 6) AS score", 1).replace("FROM tf, stats WHERE", f"FROM tf JOIN (SELECT vec_id AS doc_id, 1 - (1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))) AS distance FROM ({_PARTS}) GROUP BY vec_id) USING (doc_id), stats WHERE").rsplit("ORDER BY", 1)[0] + "ORDER BY score DESC, doc_id LIMIT 10",
)
def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Half BM25, half cosine similarity, over documents that have a vector of the same id."""
    docs, vectors = parquet(spark, folder, "documents"), parquet(spark, folder, "embeddings")
    query, target = " ".join(_TERMS), F.array(*[F.lit(x) for x in _QUERY_VECTOR])
    stats = search.corpus_stats(docs, "text", query)
    hits = docs.filter(TX.matches(F.col("text"), query)).select("doc_id", search.bm25(F.col("text"), query, stats).alias("b"))
    near = vectors.select(F.col("vec_id").alias("doc_id"), (1 - V.cosine(F.col("embedding"), target)).alias("c"))
    both = hits.join(near, "doc_id").select("doc_id", F.round(0.5 * F.col("b") + 0.5 * F.col("c"), 6).alias("score"))
    return both.orderBy(F.desc("score"), "doc_id").limit(10)


@_op("ann_cells")
def _ann(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate neighbours by cells; recall is tested against exact search."""
    vectors = parquet(spark, folder, "embeddings")
    cells = search.Cells.fit(vectors, "vec_id", "embedding")
    return cells.search(cells.assign(vectors, "embedding"), "vec_id", "embedding", _QUERY_VECTOR, 10)


# --- statements that change tables ------------------------------------------------------------------


def _changed(spark: SparkSession, folder: str, *statements: str, query: str) -> DataFrame:
    from tessella.connection import connect

    connection = connect(spark=spark)
    connection.load("supplier", parquet(spark, folder, "supplier"), primary_key="s_suppkey")
    for s in statements:
        connection.execute(s)
    return connection.query(query).df


def _dml(name: str, oracle: str, *statements: str, query: str = "SELECT * FROM supplier") -> None:
    _op(name, oracle)(lambda spark, d: _changed(spark, d, *statements, query=query))


_dml("dml_insert", "SELECT * FROM supplier UNION ALL SELECT 1000000, 'new one', 3, -1.5 UNION ALL SELECT 1000001, NULL, 4, 2.0", "INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1000000, 'new one', 3, -1.5), (1000001, NULL, 4, 2)")
_dml("dml_update", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal * 2 + s_suppkey ELSE s_acctbal END AS s_acctbal FROM supplier", "UPDATE supplier SET s_acctbal = s_acctbal * 2 + s_suppkey WHERE s_nationkey = 3")
_dml("dml_delete", "SELECT * FROM supplier WHERE NOT (s_acctbal < 1000 OR s_name ILIKE '%7')", "DELETE FROM supplier WHERE s_acctbal < 1000 OR s_name LIKE '%7'")
_dml("alter_add", "SELECT *, 5 AS stars FROM supplier", "ALTER TABLE supplier ADD COLUMN stars INTEGER DEFAULT 5")
_dml("alter_drop", "SELECT s_suppkey, s_nationkey AS nation, s_acctbal FROM supplier", "ALTER TABLE supplier DROP COLUMN s_name", "ALTER TABLE supplier RENAME COLUMN s_nationkey TO nation")
_dml("transaction", "SELECT count(*) AS n FROM supplier", "BEGIN", "DELETE FROM supplier", "ROLLBACK", query="SELECT COUNT(*) AS n FROM supplier")
_dml("catalog_scan", "SELECT 'table' AS type, 'supplier' AS name UNION ALL SELECT 'index', 'tessella_autoindex_supplier_s_suppkey' UNION ALL SELECT 'index', 'by_nation'", "CREATE INDEX by_nation ON supplier (s_nationkey)", query="SELECT type, name FROM tessella_master")


# --- full-text search from stored postings ------------------------------------------------------------

_SEARCH = f"SELECT doc_id FROM documents WHERE fts_match(text, '{' '.join(_TERMS)}') ORDER BY bm25_score(text, '{' '.join(_TERMS)}') DESC LIMIT 10"
_CONNECTED: dict[tuple, object] = {}


def _searched(spark: SparkSession, folder: str, *statements: str) -> DataFrame:
    """A search over documents with an index, after some statements; a session builds the table once for a folder."""
    from tessella.connection import connect

    key = spark.sparkContext.applicationId, folder, *statements
    if key not in _CONNECTED:
        connection = connect(spark=spark)
        connection.load("documents", parquet(spark, folder, "documents"), primary_key="doc_id")
        connection.execute("CREATE INDEX words ON documents USING fts (text)")
        for s in statements:
            connection.execute(s)
        _CONNECTED[key] = connection
    return _CONNECTED[key].query(_SEARCH).df


_op("sql_bm25", f"SELECT doc_id FROM ({_bm25_sql(10)})")(_searched)
_op(
    "sql_bm25_changed",
    f"SELECT doc_id FROM ({_bm25_sql(10)})".replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id = 44 THEN 'Apache license, the license' ELSE text END AS text FROM documents WHERE doc_id >= 20 UNION ALL SELECT 100000001, 'the apache')"),
)(
    lambda spark, d: _searched(
        spark, d, "DELETE FROM documents WHERE doc_id < 20", "UPDATE documents SET text = 'Apache license, the license' WHERE doc_id = 44",
        "INSERT INTO documents (doc_id, text) VALUES (100000001, 'the apache')",
    )
)


# --- transactions, declarations, parameters -----------------------------------------------------------

_dml("txn_commit", "SELECT * FROM supplier WHERE s_nationkey <> 3", "BEGIN", "DELETE FROM supplier WHERE s_nationkey = 3", "COMMIT")
_dml("rename_table", "SELECT * FROM supplier", "ALTER TABLE supplier RENAME TO vendors", query="SELECT * FROM vendors")
_dml("drop_table", "SELECT 'supplier' AS name", "CREATE TABLE gone (a INTEGER PRIMARY KEY)", "DROP TABLE gone", query="SELECT name FROM tessella_master WHERE type = 'table'")
_dml("drop_index", "SELECT 'by_name' AS name", "CREATE INDEX by_nation ON supplier (s_nationkey)", "CREATE INDEX by_name ON supplier (s_name)", "DROP INDEX by_nation", query="SELECT name FROM tessella_master WHERE type = 'index' AND name LIKE 'by%'")
_dml("pragma_journal", "SELECT 'mvcc' AS journal_mode", "PRAGMA journal_mode = mvcc", query="PRAGMA journal_mode")


def _loaded(spark: SparkSession, folder: str, path: str | None = None):
    from tessella.connection import connect

    connection = connect(path, spark)
    connection.load("supplier", parquet(spark, folder, "supplier"), primary_key="s_suppkey")
    return connection


@_op("parameters", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 100.5 AND s_name LIKE 'Supplier%'")
def _parameters(spark: SparkSession, folder: str) -> DataFrame:
    statement = _loaded(spark, folder).prepare("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = ? AND s_acctbal > ? AND s_name LIKE ?")
    return statement.query_with_params([7, 100.5, "Supplier%"]).df


@_op("unique_violation", "SELECT * FROM supplier")
def _unique(spark: SparkSession, folder: str) -> DataFrame:
    """An INSERT whose second row repeats a key changes nothing."""
    from tessella.errors import GeneralError

    connection = _loaded(spark, folder)
    try:
        connection.execute("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1000000, 'new', 1, 1.0), (1, 'again', 1, 1.0)")
    except GeneralError as e:
        if "UNIQUE" not in str(e):
            raise
    else:
        raise AssertionError("the repeated key was taken")
    return connection.query("SELECT * FROM supplier").df


@_op("concurrent_commit", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN 0.0 WHEN s_nationkey = 4 THEN 1.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _both_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Two transactions at a time that change different rows."""
    one = _loaded(spark, folder)
    one.execute("PRAGMA journal_mode = mvcc")
    two = one.connect()
    for c, nation, value in ((one, 3, "0.0"), (two, 4, "1.0")):
        c.execute("BEGIN CONCURRENT")
        c.execute(f"UPDATE supplier SET s_acctbal = {value} WHERE s_nationkey = {nation}")
    one.execute("COMMIT")
    two.execute("COMMIT")
    return one.query("SELECT * FROM supplier").df


@_op("concurrent_conflict", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _second_loses(spark: SparkSession, folder: str) -> DataFrame:
    """Of two transactions that change the same rows, the first to commit wins."""
    from tessella.errors import Busy

    one = _loaded(spark, folder)
    one.execute("PRAGMA journal_mode = mvcc")
    two = one.connect()
    for c, value in ((one, "0.0"), (two, "1.0")):
        c.execute("BEGIN CONCURRENT")
        c.execute(f"UPDATE supplier SET s_acctbal = {value} WHERE s_nationkey = 3")
    one.execute("COMMIT")
    try:
        two.execute("COMMIT")
    except Busy:
        return one.query("SELECT * FROM supplier").df
    raise AssertionError("both transactions were taken")
