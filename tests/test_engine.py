import os
import socket

import pytest

import tessella
from tessella import Busy, EngineError, GeneralError, NotImplementedFeature
from tessella.connection import split_script


@pytest.fixture()
def db(spark):
    c = tessella.connect(spark=spark)
    yield c
    c.close()


def rows(c, sql, *params):
    return [tuple(r) for r in c.prepare(sql).query_with_params(list(params))]


@pytest.fixture()
def emp(db):
    db.execute("CREATE TABLE emp (id INTEGER PRIMARY KEY, name TEXT, dept TEXT, salary INTEGER, rate REAL, ok BOOLEAN)")
    db.execute("INSERT INTO emp (name, dept, salary, rate, ok) VALUES ('Ann','eng',100,1.5,TRUE),('bob','eng',200,-2,FALSE),('Cy','ops',150,NULL,TRUE),('Dee',NULL,NULL,0.25,NULL),('e_e','ops',150,3,FALSE)")
    return db


def test_expressions(emp):
    q = lambda where: [r[0] for r in rows(emp, f"SELECT id FROM emp WHERE {where} ORDER BY id")]
    assert q("name LIKE 'A%'") == [1] and q("name LIKE 'B_B'") == [2] and q(r"name LIKE 'e\_e'") == [5] and q("name NOT LIKE '%e%'") == [1, 2, 3]
    assert q("name ILIKE 'cY'") == [3] and q("name LIKE dept") == [] and q("salary LIKE '1%'") == [1, 3, 5]
    assert q("dept IN ('ops', NULL)") == [3, 5] and q("dept NOT IN ('ops', NULL)") == [] and q("dept NOT IN ('ops')") == [1, 2]
    assert q("dept IS NULL") == [4] and q("NOT dept = 'eng'") == [3, 5] and q("ok") == [1, 3] and q("NOT ok") == [2, 5]
    assert q("salary / 70 = 2") == [2, 3, 5] and q("-salary / 70 = -1") == [1] and q("salary % 70 = 10") == [3, 5] and q("rate + 1 > 2") == [1, 5]
    assert q("name || ':' || rate = 'e_e:3'") == [5] and q("salary = '150'") == [3, 5] and q("salary - 100") == [2, 3, 5] and q("NULL = NULL") == []
    assert q("(salary > 100 AND dept = 'ops') OR id = 1") == [1, 3, 5] and q("+salary * 2 >= 400") == [2]
    for bad in ("name + 1 = 2", "NOT salary", "name", "nope = 1", "x.id = 1", "COUNT(*) > 1", "length(name) = 3"):
        with pytest.raises(EngineError):
            q(bad)
    for sql in ("salary / 0 = 1", "rate % 0 = 1"):
        with pytest.raises(GeneralError, match="zero"):
            q(sql)


def test_projection_order_limit_distinct(emp):
    assert emp.query("SELECT * FROM emp").columns == ["id", "name", "dept", "salary", "rate", "ok"]
    assert emp.query("SELECT e.name AS n, id FROM emp e LIMIT 1").columns == ["n", "id"]
    assert rows(emp, "SELECT id FROM emp ORDER BY salary LIMIT 2") == [(4,), (1,)] and rows(emp, "SELECT id FROM emp ORDER BY salary DESC LIMIT 3") == [(2,), (3,), (5,)]
    assert rows(emp, "SELECT id FROM emp ORDER BY rate * -1") == [(3,), (5,), (1,), (4,), (2,)] and rows(emp, "SELECT id FROM emp LIMIT 0") == []
    assert sorted(rows(emp, "SELECT DISTINCT dept FROM emp"), key=str) == [("eng",), ("ops",), (None,)]
    assert rows(emp, "SELECT DISTINCT dept FROM emp ORDER BY id DESC") == [("ops",), (None,), ("eng",)]
    assert rows(emp, "SELECT name AS n FROM emp ORDER BY n LIMIT 1") == [("Ann",)]
    with pytest.raises(GeneralError):
        rows(emp, "SELECT emp.id FROM emp AS e")


def test_aggregates(emp):
    assert rows(emp, "SELECT COUNT(*), COUNT(dept), COUNT(DISTINCT dept), SUM(salary), AVG(salary), MIN(name), MAX(rate), SUM(ok) FROM emp") == [(5, 4, 2, 600, 150.0, "Ann", 3.0, 2)]
    assert emp.query("SELECT COUNT(*), SUM(emp.salary), count(distinct dept) FROM emp").columns == ["COUNT(*)", "SUM(emp.salary)", "COUNT(DISTINCT dept)"]
    assert rows(emp, "SELECT COUNT(*), SUM(salary), MIN(id) FROM emp WHERE id > 99") == [(0, None, None)]
    assert sorted(rows(emp, "SELECT dept, COUNT(*) FROM emp GROUP BY dept"), key=str) == [("eng", 2), ("ops", 2), (None, 1)]
    assert rows(emp, "SELECT dept, SUM(salary) AS s FROM emp GROUP BY dept HAVING s > 0 ORDER BY dept DESC") == [("ops", 300), ("eng", 300)]
    assert rows(emp, "SELECT dept FROM emp GROUP BY dept HAVING COUNT(*) > 1 AND MAX(salary) = 200") == [("eng",)]
    assert rows(emp, "SELECT dept, COUNT(*) FROM emp GROUP BY dept ORDER BY COUNT(*) LIMIT 1") == [(None, 1)]
    for bad in ("SELECT name, COUNT(*) FROM emp GROUP BY dept", "SELECT SUM(name) FROM emp", "SELECT dept FROM emp GROUP BY dept HAVING name = 'x'", "SELECT * FROM emp GROUP BY dept"):
        with pytest.raises(EngineError):
            rows(emp, bad)


@pytest.fixture()
def two(db):
    db.execute("CREATE TABLE l (id INTEGER PRIMARY KEY, k INTEGER, a TEXT)")
    db.execute("CREATE TABLE r (rid INTEGER PRIMARY KEY, k INTEGER, b TEXT)")
    db.execute("INSERT INTO l (k, a) VALUES (1,'x'),(2,'y'),(NULL,'z')")
    db.execute("INSERT INTO r (k, b) VALUES (2,'p'),(3,'q'),(NULL,'s')")
    return db


def test_joins(two):
    s = lambda sql: sorted(rows(two, sql), key=str)
    assert s("SELECT a, b FROM l JOIN r ON l.k = r.k") == [("y", "p")]
    assert s("SELECT a, b FROM l LEFT JOIN r ON l.k = r.k") == [("x", None), ("y", "p"), ("z", None)]
    assert s("SELECT a, b FROM l RIGHT JOIN r ON l.k = r.k") == [("y", "p"), (None, "q"), (None, "s")]
    assert len(s("SELECT a, b FROM l FULL OUTER JOIN r ON l.k = r.k")) == 5 and len(s("SELECT a FROM l CROSS JOIN r")) == 9
    assert s("SELECT a, b FROM l JOIN r ON l.k < r.k") == [("x", "p"), ("x", "q"), ("y", "q")]
    assert s("SELECT a FROM l LEFT JOIN r ON l.k = r.k WHERE b IS NULL") == [("x",), ("z",)]
    assert two.query("SELECT * FROM l JOIN r USING (k)").columns == ["id", "k", "a", "rid", "b"] and s("SELECT * FROM l NATURAL JOIN r") == [(2, 2, "y", 1, "p")]
    assert sorted(rows(two, "SELECT k, b FROM l FULL JOIN r USING (k)"), key=str) == [(1, None), (2, "p"), (3, "q"), (None, "s"), (None, None)]
    assert s("SELECT x.a, y.a FROM l AS x JOIN l AS y ON x.id + 1 = y.id") == [("x", "y"), ("y", "z")]
    assert s("SELECT l.a, COUNT(r.b) FROM l LEFT JOIN r ON l.k = r.k GROUP BY l.a") == [("x", 0), ("y", 1), ("z", 0)]
    for bad in ("SELECT k FROM l JOIN r ON l.k = r.k", "SELECT a FROM l JOIN l ON 1 = 1", "SELECT a FROM l JOIN r USING (zz)", "SELECT a FROM l JOIN r ON x.k = r.k", "SELECT a FROM l JOIN tessella_master ON 1 = 1"):
        with pytest.raises(EngineError):
            rows(two, bad)


def test_writes_and_constraints(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER NOT NULL DEFAULT 7, r REAL, j JSON, v VECTOR(2))")
    assert db.execute("INSERT INTO t (u, r, j, v) VALUES ('a', 1, '{\"x\": 1}', [1, 2])") == "INSERT Statement executed."
    db.execute("INSERT INTO t (r, id, u) VALUES (-2.5, 10, 'b'), (NULL, 3, NULL)")
    assert rows(db, "SELECT id, u, n, r FROM t ORDER BY id") == [(1, "a", 7, 1.0), (3, None, 7, None), (10, "b", 7, -2.5)]
    db.execute("INSERT INTO t (u) VALUES ('c')")
    assert rows(db, "SELECT id FROM t WHERE u = 'c'") == [(11,)]
    before = rows(db, "SELECT * FROM t ORDER BY id")
    for bad in (
        "INSERT INTO t (u) VALUES ('a')", "INSERT INTO t (u) VALUES ('x'), ('x')", "INSERT INTO t (id) VALUES (1)", "INSERT INTO t (id) VALUES (NULL)", "INSERT INTO t (n) VALUES (NULL)", "INSERT INTO t (n) VALUES ('x')", "INSERT INTO t (n) VALUES (1.5)",
        "INSERT INTO t (j) VALUES ('{')", "INSERT INTO t (v) VALUES ([1])", "INSERT INTO t (zz) VALUES (1)", "INSERT INTO t (u, n) VALUES ('q')", "UPDATE t SET u = 'a'", "UPDATE t SET n = NULL", "UPDATE t SET n = u", "UPDATE t SET zz = 1",
        "UPDATE t SET u = 'b' WHERE id = 1", "UPDATE t SET n = 1 / (id - 3)", "DELETE FROM nope", "INSERT INTO tessella_master (name) VALUES ('x')", "DELETE FROM tessella_master", "UPDATE t SET v = [1, 2, 3]",
    ):
        with pytest.raises(EngineError):
            db.execute(bad)
        assert rows(db, "SELECT * FROM t ORDER BY id") == before
    assert db.execute("UPDATE t AS x SET n = x.n + id, u = u || '!' WHERE id < 5") == "UPDATE Statement executed. 2 rows updated."
    assert rows(db, "SELECT n, u FROM t ORDER BY id") == [(8, "a!"), (10, None), (7, "b"), (7, "c")]
    assert db.execute("UPDATE t SET n = 0 WHERE id = 999") == "UPDATE Statement executed. 0 rows updated."
    assert db.execute("UPDATE t SET id = id + 100 WHERE id = 3") == "UPDATE Statement executed. 1 row updated."
    assert db.execute("DELETE FROM t WHERE n = 7") == "DELETE Statement executed. 2 rows deleted." and rows(db, "SELECT id FROM t ORDER BY id") == [(1,), (103,)]
    assert db.execute("DELETE FROM t") == "DELETE Statement executed. 2 rows deleted." and rows(db, "SELECT COUNT(*) FROM t") == [(0,)]


def test_declarations(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, f REAL, CHECK (f > 0))")
    assert "no-op" in db.execute("CREATE TABLE IF NOT EXISTS t (a TEXT)")
    db.execute("INSERT INTO t (a, f) VALUES ('x', 1), ('x', 2)")
    db.execute("CREATE INDEX i ON t (a)")
    db.execute("CREATE INDEX IF NOT EXISTS i ON t (a)")
    for bad in (
        "CREATE TABLE t (a TEXT)", "CREATE TABLE tessella_master (a TEXT)", "CREATE TABLE q (a TEXT, a TEXT)", "CREATE TABLE q (a TEXT PRIMARY KEY)", "CREATE TABLE q (a INTEGER PRIMARY KEY, b INTEGER PRIMARY KEY)", "CREATE TABLE q (a BLOB)",
        "CREATE TABLE q (v VECTOR)", "CREATE TABLE q (v VECTOR(0))", "CREATE TABLE q (a INTEGER DEFAULT 'x')", "CREATE UNIQUE INDEX u ON t (a)", "CREATE INDEX j ON t (f)", "CREATE INDEX i ON t (a)", "CREATE INDEX h ON t USING hnsw (a)",
        "CREATE INDEX h ON t USING fts (id)", "CREATE INDEX h ON t USING rtree (a)", "CREATE INDEX h ON t (zz)", "DROP TABLE nope", "DROP INDEX nope", "DROP INDEX tessella_autoindex_t_id", "ALTER TABLE t DROP COLUMN id", "ALTER TABLE t DROP COLUMN zz",
        "ALTER TABLE t ADD COLUMN a TEXT", "ALTER TABLE t ADD COLUMN b TEXT UNIQUE", "ALTER TABLE t ADD COLUMN b TEXT NOT NULL", "ALTER TABLE t RENAME COLUMN zz TO y", "ALTER TABLE t RENAME COLUMN a TO f", "ALTER TABLE nope RENAME TO z",
    ):
        with pytest.raises(EngineError):
            db.execute(bad)
    db.execute("ALTER TABLE t ADD COLUMN b TEXT NOT NULL DEFAULT 'd'")
    db.execute("ALTER TABLE t ADD COLUMN c INTEGER")
    db.execute("ALTER TABLE t RENAME COLUMN a TO z")
    assert rows(db, "SELECT z, b, c FROM t") == [("x", "d", None)] * 2
    db.execute("ALTER TABLE t DROP COLUMN z")
    db.execute("ALTER TABLE t ADD COLUMN z TEXT")
    assert rows(db, "SELECT z FROM t") == [(None,)] * 2
    db.execute("ALTER TABLE t RENAME TO s")
    db.execute("ALTER TABLE IF EXISTS t RENAME TO q")
    assert [r[1] for r in rows(db, "SELECT type, name FROM tessella_master")] == ["s", "tessella_autoindex_s_id"]
    assert db.execute("DROP TABLE IF EXISTS nope") == "DROP TABLE Statement executed. 0 tables dropped." and db.execute("DROP TABLE s") == "DROP TABLE Statement executed. 1 table dropped."
    assert rows(db, "PRAGMA table_list") == [("main", "tessella_master", "table", 5, 0, 0)]


def test_functions(db):
    db.execute("CREATE TABLE d (id INTEGER PRIMARY KEY, body TEXT, v VECTOR(2), j JSON)")
    db.execute("""INSERT INTO d (body, v, j) VALUES ('red fox, red dog',[1,0],'{"b":{"t":[1,"two",null,true,2.5]},"a":1}'),('blue dog',[0,2],'{"b":{"t":[]},"a":null}'),('',[1,1],NULL)""")
    with pytest.raises(GeneralError, match="FTS"):
        rows(db, "SELECT id FROM d WHERE fts_match(body, 'red')")
    db.execute("CREATE INDEX f ON d USING fts (body)")
    q = lambda where: [r[0] for r in rows(db, f"SELECT id FROM d WHERE {where} ORDER BY id")]
    assert q("fts_match(body, 'RED cat')") == [1] and q("fts_match(body, '')") == [] and q("bm25_score(body, 'dog') > 0") == [1, 2]
    assert rows(db, "SELECT id FROM d ORDER BY bm25_score(body, 'dog') DESC LIMIT 3") == [(2,), (1,), (3,)]
    assert rows(db, "SELECT id FROM d ORDER BY vec_distance_l2(v, [0, 1]) LIMIT 2") == [(2,), (3,)]
    assert rows(db, "SELECT id FROM d WHERE id > 1 ORDER BY vec_distance_dot(v, ?) LIMIT 1", [1.0, 0.0]) == [(3,)]
    assert rows(db, "SELECT id FROM d ORDER BY vec_distance_cosine(v, [1, 0]) DESC LIMIT 1") == [(2,)]
    assert q("json_extract(j, '$.a') = 1") == [1] and q("json_extract(j, '$.b.t[1]') = 'two'") == [1] and q("json_extract(j, '$.nope') IS NULL") == [1, 2, 3]
    for i, kind in enumerate(("integer", "text", "null", "true", "real")):
        assert q(f"json_type(j, '$.b.t[{i}]') = '{kind}'") == [1]
    assert q("json_type(j) = 'object'") == [1, 2] and q("json_type(j, '$.b.t') = 'array'") == [1, 2] and q("json_array_length(j, '$.b.t') = 0") == [2]
    assert q("json_object_keys(j) = '[\"b\",\"a\"]'") == [1, 2]
    for bad in ("json_type(j, 'a') = 'x'", "json_type(j, '$.a[*]') = 'x'", "json_array_length(j, '$.a') = 1", "json_extract(id) = 1", "vec_distance_l2(v, [1]) = 1", "vec_distance_l2(v) = 1", "vec_distance_l2(id, v) = 1", "vec_distance_cosine(v, [0, 0]) = 1", "fts_match('x', 'y')"):
        with pytest.raises(EngineError):
            q(bad)


def test_transactions(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("BEGIN")
    with pytest.raises(GeneralError):
        db.execute("BEGIN")
    db.execute("INSERT INTO t (n) VALUES (1)")
    with pytest.raises(GeneralError):
        db.execute("INSERT INTO t (id) VALUES (1)")
    assert db.in_transaction()
    with pytest.raises(GeneralError):
        db.execute("VACUUM")
    db.execute("ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM t") == [(0,)] and not db.in_transaction()
    db.execute("START TRANSACTION")
    db.execute("INSERT INTO t (n) VALUES (5)")
    db.execute("COMMIT")
    assert rows(db, "SELECT n FROM t") == [(5,)]
    for bad in ("COMMIT", "ROLLBACK", "BEGIN CONCURRENT"):
        with pytest.raises(EngineError):
            db.execute(bad)


def test_concurrent_transactions(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO t (n) VALUES (1), (2), (3)")
    db.execute("PRAGMA journal_mode = MVCC")
    a, b = db.connect(), db.connect()
    assert db.handle_count() == 3
    for c in (a, b):
        c.execute("BEGIN CONCURRENT")
    a.execute("UPDATE t SET n = 10 WHERE id = 1")
    b.execute("UPDATE t SET n = 20 WHERE id = 2")
    b.execute("DELETE FROM t WHERE id = 3")
    assert rows(b, "SELECT n FROM t ORDER BY id") == [(1,), (20,)] and rows(db, "SELECT n FROM t ORDER BY id") == [(1,), (2,), (3,)]
    with pytest.raises(NotImplementedFeature):
        a.execute("CREATE TABLE u (a TEXT)")
    assert a.execute("COMMIT") == "COMMIT" and b.execute("COMMIT") == "COMMIT"
    assert rows(db, "SELECT n FROM t ORDER BY id") == [(10,), (20,)]
    for c in (a, b):
        c.execute("BEGIN CONCURRENT")
        c.execute("UPDATE t SET n = n + 1 WHERE id = 1")
    a.execute("COMMIT")
    with pytest.raises(Busy) as e:
        b.execute("COMMIT")
    assert e.value.retryable and not b.concurrent_tx_is_open()
    for c in (a, b):
        c.execute("BEGIN CONCURRENT")
        c.execute("INSERT INTO t (n) VALUES (7)")
    a.execute("COMMIT")
    with pytest.raises(Busy):
        b.execute("COMMIT")
    assert rows(db, "SELECT id, n FROM t ORDER BY id") == [(1, 11), (2, 20), (4, 7)]


def test_persistence(spark, tmp_path):
    path = str(tmp_path / "db")
    c = tessella.Connection.open(path, spark)
    c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT DEFAULT 'x', v VECTOR(2))")
    for i in range(3):
        c.execute(f"INSERT INTO t (v) VALUES ([{i}, 1])")
    c.execute("DELETE FROM t WHERE id = 3")
    c.execute("CREATE INDEX h ON t USING hnsw (v) WITH (metric = 'cosine')")
    with pytest.raises(EngineError):
        tessella.Connection.open(path, spark)
    assert c.execute("VACUUM").startswith("VACUUM completed.")
    c.execute("BEGIN")
    c.execute("DELETE FROM t")
    c.close()
    r, again = tessella.Connection.open_read_only(path, spark), tessella.Connection.open_read_only(path, spark)
    assert rows(r, "SELECT id, a FROM t ORDER BY id") == [(1, "x"), (2, "x")] and r.is_read_only()
    assert "metric = 'cosine'" in rows(r, "SELECT sql FROM tessella_master WHERE name = 'h'")[0][0]
    for bad in ("DELETE FROM t", "BEGIN", "CREATE TABLE q (a TEXT)"):
        with pytest.raises(GeneralError, match="read-only"):
            r.execute(bad)
    r.close()
    again.close()
    c = tessella.Connection.open(path, spark)
    c.execute("INSERT INTO t (a) VALUES ('new')")
    assert rows(c, "SELECT id FROM t WHERE a = 'new'") == [(4,)]
    c.close()


def test_statements_and_cursor(emp):
    s = emp.prepare("SELECT name FROM emp WHERE salary > ? AND dept = ? ORDER BY id LIMIT ?")
    assert s.parameter_count == 3 and s.column_names is None
    assert [r.get(0, str) for r in s.query_with_params([120, "ops", 1])] == ["Cy"]
    for bad in ([1], [1, "x", -1]):
        with pytest.raises(GeneralError):
            s.query_with_params(bad)
    assert emp.prepare_cached("SELECT id FROM emp") is emp.prepare_cached("SELECT id FROM emp")
    emp.set_prepared_cache_capacity(0)
    row = emp.query("SELECT id, ok, rate FROM emp ORDER BY id").next()
    assert row.get(0, float) == 1.0 and row.get(0, bool) is True and row.get_by_name("rate") == 1.5
    with pytest.raises(GeneralError):
        row.get(2, int)
    assert emp.prepare("UPDATE emp SET salary = ? WHERE id = ?").execute_with_params([1, 1]) == "UPDATE Statement executed. 1 row updated."
    cur = emp.cursor()
    cur.executemany("INSERT INTO emp (name, salary) VALUES (?, ?)", [("x", 1), ("y", 2)])
    cur.executescript("DELETE FROM emp WHERE name = 'x'; -- gone;\nUPDATE emp SET name = 'a;b' WHERE name = 'y';")
    cur.execute("SELECT name, salary FROM emp WHERE id > ? ORDER BY id", [5])
    assert [d[0] for d in cur.description] == ["name", "salary"] and cur.fetchone() == ("a;b", 2) and cur.fetchone() is None and cur.rowcount == -1
    assert cur.execute("SELECT id FROM emp ORDER BY id").fetchmany(2) == [(1,), (2,)] and split_script(";; SELECT a FROM t;") == [" SELECT a FROM t"]
    out = emp.execute_with_render("SELECT id FROM emp WHERE id = 1")
    assert out.status == "SELECT Statement executed. 1 row returned." and "| id |" in out.rendered


def test_pragmas(db):
    assert rows(db, "PRAGMA journal_mode") == [("wal",)] and rows(db, "PRAGMA auto_vacuum") == [("0.25",)]
    db.execute("PRAGMA auto_vacuum = OFF")
    assert db.auto_vacuum_threshold() is None
    db.execute("PRAGMA auto_vacuum(0.5)")
    assert db.auto_vacuum_threshold() == 0.5
    for bad in ("PRAGMA auto_vacuum = 2", "PRAGMA auto_vacuum = WAL", "PRAGMA journal_mode = delete", "PRAGMA journal_mode = 1", "PRAGMA table_list = 1", "PRAGMA synchronous"):
        with pytest.raises(EngineError):
            db.execute(bad)
    assert db.execute("VACUUM") == "VACUUM is a no-op for in-memory databases" and db.execute("") == ""


def test_vacuum_waits_for_concurrent_transactions(spark, tmp_path):
    one = tessella.connect(str(tmp_path / "db"), spark)
    one.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)")
    one.execute("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')")
    one.execute("PRAGMA journal_mode = mvcc")
    two = one.connect()
    two.execute("BEGIN CONCURRENT")
    one.execute("UPDATE t SET b = 'z' WHERE a = 1")
    with pytest.raises(GeneralError, match="VACUUM"):
        one.execute("VACUUM")
    assert [tuple(r) for r in two.query("SELECT b FROM t ORDER BY a").collect_all()] == [("x",), ("y",)]
    two.execute("ROLLBACK")
    one.execute("VACUUM")
    assert [tuple(r) for r in one.query("SELECT b FROM t ORDER BY a").collect_all()] == [("z",), ("y",)]
    two.close()
    one.close()


def test_a_writer_that_dies_leaves_the_manifest_before(spark, tmp_path):
    folder = tmp_path / "db"
    db = tessella.connect(str(folder), spark)
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
    db.execute("INSERT INTO t (a) VALUES (1)")
    db.close()
    newest = max(p.name for p in folder.glob("manifest-*.json"))
    number = int(newest[9:-5])
    (folder / f"manifest-{number + 1:012d}.json").write_text('{"format": 1, "tab')  # cut off
    (folder / "writer.lock").write_text(f"{socket.gethostname()} 999999999")  # and its process is gone
    db = tessella.connect(str(folder), spark)
    assert [tuple(r) for r in db.query("SELECT a FROM t").collect_all()] == [(1,)]
    db.execute("INSERT INTO t (a) VALUES (2)")
    db.close()
    assert len(list(folder.glob("manifest-*.json"))) <= 3
    with tessella.connect(str(folder), spark) as db:
        assert db.query("SELECT COUNT(*) AS n FROM t").next()["n"] == 2


def test_another_process_keeps_writers_out(spark, tmp_path):
    folder = tmp_path / "db"
    folder.mkdir()
    (folder / "writer.lock").write_text(f"{socket.gethostname()} {os.getppid()}")
    with pytest.raises(EngineError, match="in use"):
        tessella.connect(str(folder), spark)


def test_json_keys_with_spaces(spark):
    db = tessella.connect(spark=spark)
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, j JSON)")
    db.execute("""INSERT INTO t (a, j) VALUES (1, '{"a b": {"c": [1, 2]}}')""")
    assert db.query("SELECT a FROM t WHERE json_extract(j, '$.a b.c[1]') = 2").next()["a"] == 1
    db.close()
