"""Stored postings: results equal those of scans after any change; plans read terms only.  The shell."""

import io
from dataclasses import replace

import pytest

import tessella
from tessella.repl import HELP, Shell, run

QUERY = "SELECT id FROM d WHERE fts_match(body, 'red fox') ORDER BY bm25_score(body, 'red fox') DESC LIMIT 5"
TEXTS = [(1, "red fox, red dog"), (2, "blue dog"), (3, ""), (4, None), (5, "a fox and a fox"), (6, "red fox, red dog")]


@pytest.fixture()
def db(spark):
    c = tessella.connect(spark=spark)
    c.load("d", spark.createDataFrame(TEXTS, "id long, body string").repartition(3), primary_key="id")
    c.execute("CREATE INDEX f ON d USING fts (body)")
    yield c
    c.close()


def ids(c, sql=QUERY):
    return [r[0] for r in c.query(sql)]


def same_as_scan(c, table="d"):
    """Results from postings, which must cover the table, and equal results without them."""
    queries = [q.replace(" d ", f" {table} ") for q in (QUERY, "SELECT id FROM d WHERE NOT fts_match(body, 'fox') ORDER BY id", "SELECT id FROM d ORDER BY bm25_score(body, 'dog fox dog') DESC LIMIT 9")]
    found, told = [ids(c, q) for q in queries], c.tables[table]
    assert {f[0] for s in told.segments for f in s.files} >= set(told.files)
    c._db.tables[table] = replace(told, segments=())
    assert found == [ids(c, q) for q in queries]
    c._db.tables[table] = told
    return found[0]


def test_postings_follow_every_change(db):
    assert same_as_scan(db) == [1, 6, 5]
    db.execute("INSERT INTO d (id, body) VALUES (7, 'fox'), (8, NULL)")
    assert same_as_scan(db)[-1] in (5, 7) and len(db.tables["d"].segments) == 2
    db.execute("UPDATE d SET body = 'no more' WHERE id = 1")
    assert 1 not in same_as_scan(db)
    db.execute("DELETE FROM d WHERE id = 6")
    assert set(same_as_scan(db)) == {5, 7}
    db.execute("ALTER TABLE d RENAME TO e")
    assert set(same_as_scan(db, "e")) == {5, 7}
    db.execute("DELETE FROM e")
    assert db.tables["e"].segments == () and ids(db, QUERY.replace(" d ", " e ")) == []
    db.execute("DROP INDEX f")
    assert db.tables["e"].segments == ()


def test_postings_in_transactions(db):
    db.execute("BEGIN")
    db.execute("DELETE FROM d WHERE id = 1")
    db.execute("ROLLBACK")
    assert same_as_scan(db) == [1, 6, 5]
    db.execute("PRAGMA journal_mode = mvcc")
    two = db.connect()
    for c, sql in ((db, "UPDATE d SET body = 'red' WHERE id = 2"), (two, "UPDATE d SET body = 'fox red fox' WHERE id = 3")):
        c.execute("BEGIN CONCURRENT")
        c.execute(sql)
    assert 2 in ids(db) and 2 not in ids(two) and 3 in ids(two)
    db.execute("COMMIT")
    two.execute("COMMIT")
    assert {2, 3} <= set(same_as_scan(db))


def test_postings_are_kept_with_the_database(spark, tmp_path):
    with tessella.connect(str(tmp_path / "x"), spark) as c:
        c.load("d", spark.createDataFrame(TEXTS, "id long, body string").repartition(3), primary_key="id")
        c.execute("CREATE INDEX f ON d USING fts (body)")
        c.execute("INSERT INTO d (id, body) VALUES (7, 'fox')")
    with tessella.connect(str(tmp_path / "x"), spark) as c:
        assert len(c.tables["d"].segments) == 2
        before = same_as_scan(c)
        c.execute("VACUUM")
        assert len(c.tables["d"].segments) == 1 and same_as_scan(c) == before


def test_plan_reads_terms_only(db):
    plan = db.query(QUERY).df._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "Inner" in plan and "Python" not in plan
    assert "body" not in plan, "the text itself isn't read"


def test_least_and_greatest_vector(db):
    db.execute("CREATE TABLE v (id INTEGER PRIMARY KEY, x VECTOR(2))")
    db.execute("INSERT INTO v (x) VALUES ([10, 0]), ([9, 0]), (NULL)")
    found = db.query("SELECT MIN(x), MAX(x) FROM v").collect_all()[0]
    assert list(found[0]) == [10.0, 0.0] and list(found[1]) == [9.0, 0.0]  # as texts


def test_shell(spark, tmp_path):
    shell, out = Shell(spark), io.StringIO()
    say = shell.line
    assert say(".tables") == "(no tables)" and all(k in say(".help") for k in HELP)
    assert say("CREATE TABLE t (id INTEGER PRIMARY KEY,") == "" and say("a TEXT);") == "CREATE TABLE Statement executed."
    assert "INSERT" in say("INSERT INTO t (a) VALUES ('x;y');") and "x;y" in say("SELECT a FROM t;") and say(".tables") == "t"
    assert say("PRAGMA journal_mode = mvcc;") and "'B'" in say(".spawn") and say("BEGIN CONCURRENT;") == "BEGIN"
    assert say(".conns") == "  A\n* B (BEGIN CONCURRENT)" and "'A'" in say(".use a")
    for bad in (".use", ".use Z", ".open", ".save", ".ask", ".ask who?", ".nope", "SELECT nope FROM t;"):
        assert say(bad).startswith("error: "), bad
    folder = str(tmp_path / "saved")
    assert say(f".save {folder}") == f"Saved database to '{folder}'." and say(f".open {folder}") == f"Opened '{folder}' (1 table)." and "x;y" in say("SELECT a FROM t;")
    run(["SELECT id FROM t;\n", ".exit\n", "SELECT a FROM t;\n"], shell, out)
    assert "1 row" in out.getvalue() and "x;y" not in out.getvalue()
