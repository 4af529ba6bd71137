"""All core queries against DuckDB, plans, search recall, tools and streams."""

import decimal
import inspect

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import tessella
from tessella import tools
from tessella.operators import search
from tessella.plans import catalog
from tessella.plans.query import select
from tessella.streaming import continuous

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 4)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    if name in catalog.SQL:
        found = duck.sql(catalog.SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        at = [found.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted([tuple(plain(r[i]) for i in at) for r in found.fetchall()], key=repr)


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(catalog.QUERIES["order_topk"](spark, SF))
    assert "TakeOrderedAndProject" in top and "o_custkey" not in top
    pushed = plan(catalog.QUERIES["filter_eq"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in pushed and "o_orderdate" not in pushed
    assert "BroadcastHashJoin" in plan(catalog.QUERIES["join_inner"](spark, SF))
    for name in catalog.QUERIES:
        assert "Python" not in plan(catalog.QUERIES[name](spark, SF)) or name.startswith(("dml", "alter", "catalog", "transaction")), name


def test_cells_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for metric in ("l2", "cosine"):
        cells = search.Cells.fit(vectors, "vec_id", "embedding", metric=metric)
        assigned = cells.assign(vectors, "embedding").cache()
        assert assigned.count() == vectors.count() and assigned.filter("cell IS NULL").count() == 0
        hits = total = 0
        for r in vectors.filter("vec_id % 500 = 7").collect():
            exact = {x.vec_id for x in search.nearest(vectors, "vec_id", "embedding", r.embedding, 10, metric).collect()}
            got = {x.vec_id for x in cells.search(assigned, "vec_id", "embedding", r.embedding, 10).collect()}
            hits, total = hits + len(exact & got), total + len(exact)
        assert hits / total >= 0.95, metric


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_cells_recall_of_every_50th_vector(spark, metric):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    cells = search.Cells.fit(vectors, "vec_id", "embedding", metric=metric)
    rows = cells.assign(vectors, "embedding").select("vec_id", "embedding", "cell").collect()
    ids, at = np.array([r.vec_id for r in rows]), np.array([r.cell for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    asked = np.flatnonzero(ids % 50 == 0)
    size = np.linalg.norm(x, axis=1)
    score = x[asked] @ x.T
    if metric == "l2":
        score = 2 * score - size**2
    elif metric == "cosine":
        score /= size
    hits = 0
    for s, q in zip(score, x[asked], strict=True):
        probed = np.isin(at, cells.probe(q, inspect.signature(cells.search).parameters["probes"].default))
        hits += len(set(ids[np.argsort(-s)[:10]]) & set(ids[probed][np.argsort(-s[probed])[:10]]))
    print(metric, len(asked), hits / (10 * len(asked)))
    assert hits / (10 * len(asked)) >= 0.95


def test_tools(spark):
    c = tessella.connect(spark=spark)
    c.load("docs", spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"), primary_key="doc_id")
    c.load("vecs", spark.read.parquet(f"{SF}/embeddings.parquet"))
    c.execute("CREATE INDEX f ON docs USING fts (text)")
    assert tools.list_tables(c) == ["docs", "vecs"] and tools.describe_table(c, "docs")["rows"] == 200
    assert "CREATE TABLE docs (" in tools.schema_dump(c)
    got = tools.query(c, "SELECT doc_id, lang FROM docs", limit=5)
    assert len(got["rows"]) == 5 and got["truncated"] and got["columns"] == ["doc_id", "lang"]
    assert tools.execute(c, "DELETE FROM docs WHERE doc_id = 1") == "DELETE Statement executed. 1 row deleted."
    hits = tools.bm25_search(c, "docs", "text", "the license", 3)
    assert len(hits) == 3 and hits[0]["score"] >= hits[1]["score"]
    near = tools.vector_search(c, "vecs", "embedding", [0.1] * 64, 4, "cosine")
    assert len(near) == 4 and near[0]["distance"] <= near[1]["distance"]
    for bad in (lambda: tools.query(c, "DELETE FROM docs"), lambda: tools.execute(c, "SELECT doc_id FROM docs"), lambda: tools.bm25_search(c, "docs", "lang", "x"), lambda: tools.describe_table(c, "x")):
        with pytest.raises(tessella.EngineError):
            bad()
    c.close()


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (
        ("big", continuous.select(stream, "events", "SELECT event_id, value FROM events WHERE value > 50"), "append"),
        ("counts", continuous.select(stream, "events", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type"), "complete"),
        ("windows", continuous.windowed_counts(stream, "ts", ["event_type"], window="1 day", late="1 day"), "complete"),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("big").count() == events.filter("value > 50").count()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {(r.event_type, r["count"]) for r in events.groupBy("event_type").count().collect()}
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    for bad in ("SELECT event_id FROM events LIMIT 1", "SELECT event_id FROM other"):
        with pytest.raises(tessella.EngineError):
            continuous.select(stream, "events", bad)


def test_select_takes_parameters(spark):
    assert select(spark, SF, "SELECT n_name FROM nation WHERE n_nationkey = ?", [3]).collect()[0][0] == "NATION_3"


def test_ties_of_plain_tables_come_in_the_order_of_what_is_shown(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", (F.col("p_partkey") % 3 + 900.5).alias("p_retailprice"))
    more = part.crossJoin(spark.range(4)).select((F.col("p_partkey") + F.col("id") * 99_900).alias("p_partkey"), "p_retailprice")
    more.repartition(5, F.col("p_partkey") % 7).sortWithinPartitions(F.desc("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.QUERIES["order_expr"](spark, str(tmp_path)).collect()] == con.sql(catalog.SQL["order_expr"]).fetchall()
    spark.range(6, 0, -1).select("id", F.create_map("id", "id").alias("m"), F.array("id").alias("v")).write.parquet(f"{tmp_path}/odd.parquet")
    for shown in ("id, m", "m, v, id", "*"):
        assert [r.id for r in select(spark, str(tmp_path), f"SELECT {shown} FROM odd ORDER BY id % 2 DESC LIMIT 4").collect()] == [1, 3, 5, 2]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
