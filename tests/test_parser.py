import pytest

from tessella.errors import EngineError, NotImplementedFeature, SqlError
from tessella.plans import ast as A
from tessella.plans.parser import parse

REJECTED = [
    "SELECT 1", "SELECT a + 1 FROM t", "SELECT *, a FROM t", "SELECT t.* FROM t", "SELECT a FROM t, u", "SELECT a FROM (SELECT a FROM t)", "SELECT a FROM t JOIN u", "SELECT a FROM t LEFT SEMI JOIN u ON t.a = u.a",
    "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a GLOB 'x'", "SELECT a FROM t WHERE a REGEXP 'x'", "SELECT a FROM t WHERE a LIKE 'x' ESCAPE '!'", "SELECT a FROM t WHERE a IN (SELECT b FROM u)",
    "SELECT a FROM t WHERE EXISTS (SELECT b FROM u)", "SELECT a FROM t WHERE CASE WHEN a THEN b END", "SELECT a FROM t WHERE CAST(a AS INT) = 1", "SELECT a FROM t ORDER BY a, b", "SELECT a FROM t ORDER BY a NULLS FIRST",
    "SELECT a FROM t LIMIT 1 OFFSET 2", "SELECT a FROM t UNION SELECT a FROM u", "WITH x AS (SELECT a FROM t) SELECT a FROM x", "SELECT SUM(DISTINCT a) FROM t", "SELECT SUM(*) FROM t", "SELECT SUM(a + 1) FROM t",
    "SELECT COUNT(*) OVER () FROM t", "SELECT COUNT(*) FILTER (WHERE a) FROM t", "SELECT a FROM t GROUP BY a + 1", "SELECT COUNT(*) FROM t HAVING COUNT(*) > 1", "SELECT DISTINCT ON (a) a FROM t", "SELECT a FROM t GROUP BY ROLLUP (a)",
    "INSERT INTO t VALUES (1)", "INSERT INTO t (a) SELECT a FROM u", "INSERT OR REPLACE INTO t (a) VALUES (1)", "INSERT INTO t (a) VALUES (1) RETURNING a", "UPDATE t SET a = 1 FROM u", "UPDATE t SET (a, b) = (1, 2)", "DELETE FROM t USING u",
    "CREATE VIEW v AS SELECT a FROM t", "CREATE TRIGGER x", "CREATE INDEX ON t (a)", "CREATE INDEX i ON t (a, b)", "CREATE INDEX i ON t (a) WHERE a > 1", "CREATE TABLE t (a INTEGER DEFAULT now())", "DROP TABLE a, b",
    "ALTER TABLE t RENAME TO u, ADD COLUMN x INT", "ALTER TABLE t ALTER COLUMN a TYPE INT", "VACUUM FULL", "SAVEPOINT s", "BEGIN IMMEDIATE", "ATTACH DATABASE x", "SELECT a FROM t WHERE a = :x", "SELECT a FROM t WHERE a = $1",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_left_out_features_are_rejected(sql):
    with pytest.raises(NotImplementedFeature):
        parse(sql)


@pytest.mark.parametrize("sql", ["SELEC a", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t t2 t3", "SELECT a FROM t; SELECT b FROM t", "INSERT INTO t (a VALUES (1)", "SELECT a FROM t WHERE v = [1, x]", "SELECT 'open FROM t"])
def test_bad_text(sql):
    with pytest.raises(EngineError):
        parse(sql)


def test_empty_texts():
    for sql in ("", " ;; ", "-- only a comment", "/* none */"):
        assert parse(sql).statement is None


def test_expressions_and_literals():
    s = parse("select A.b, count(*) as n from t as A where not x = 1 or y || 'it''s' like '%a' and z in (1, -2.5, NULL) group by A.b having n > 1 order by n desc limit 3;").statement
    assert isinstance(s, A.Select) and s.descending and s.limit == A.Literal(3) and s.where.op == "OR" and s.items[1].header == "n" and s.items[0].expr == A.Name("b", "A")
    assert parse("SELECT COUNT(DISTINCT t.c) FROM t").statement.items[0].header == "COUNT(DISTINCT t.c)"
    v = parse("SELECT a FROM t ORDER BY vec_distance_l2(v, [1, 2.5]) LIMIT ?").statement
    assert v.order.args[1] == A.Literal((1.0, 2.5)) and v.limit == A.Param(0)
    assert parse("SELECT a FROM t WHERE a = ? AND b = ?1 AND c = ?").params == 2
    assert parse("SELECT a FROM t WHERE x = 99999999999999999999").statement.where.right == A.Literal(1e20)


def test_several_statements_are_counted():
    with pytest.raises(SqlError, match="there are 3"):
        parse("SELECT a FROM t; SELECT a FROM t; SELECT a FROM t")
