"""Tool functions over a connection: what an assistant or a script needs to look around and search."""

from __future__ import annotations

from typing import Any

from tessella.connection import Connection
from tessella.engine import column_sql
from tessella.errors import GeneralError
from tessella.operators import search
from tessella.plans import ast as A
from tessella.plans.parser import parse

#: Rows of a query by default and at most; neighbours or hits at most.
DEFAULT_ROWS, MOST_ROWS, MOST_K = 100, 1000, 100


def list_tables(connection: Connection) -> list[str]:
    return sorted(connection.tables)


def describe_table(connection: Connection, name: str) -> dict[str, Any]:
    """Columns, indexes and number of rows."""
    if name not in connection.tables:
        raise GeneralError(f"Table '{name}' doesn't exist")
    t = connection.tables[name]
    columns = [{"name": c.name, "type": c.declared, "primary_key": c.primary_key, "not_null": c.not_null, "unique": c.unique, "default": c.default} for c in t.columns]
    indexes = [{"name": i.name, "column": i.column, "using": i.using, "unique": i.unique} for i in t.indexes]
    return {"name": name, "columns": columns, "indexes": indexes, "rows": t.frame(connection._db.spark).count()}


def schema_dump(connection: Connection) -> str:
    """CREATE TABLE text of all tables, sorted by name."""
    return "\n\n".join(f"CREATE TABLE {n} (\n" + ",\n".join(f"  {column_sql(c)}" for c in t.columns) + "\n);" for n, t in sorted(connection.tables.items()))


def query(connection: Connection, sql: str, limit: int = DEFAULT_ROWS) -> dict[str, Any]:
    """Rows of a SELECT as dictionaries, up to `limit`; `truncated` says whether there are more."""
    if not isinstance(parse(sql).statement, A.Select):
        raise GeneralError("query takes a SELECT; use execute for other statements")
    limit = max(1, min(limit, MOST_ROWS))
    rows = connection.query(sql)
    found = rows.df.limit(limit + 1).collect()
    return {"columns": rows.columns, "rows": [dict(zip(rows.columns, r, strict=True)) for r in found[:limit]], "truncated": len(found) > limit}


def execute(connection: Connection, sql: str) -> str:
    """The status line of a statement that isn't a SELECT."""
    if isinstance(parse(sql).statement, A.Select):
        raise GeneralError("execute takes no SELECT; use query")
    return connection.execute(sql)


def _table_and_key(connection: Connection, table: str):
    if table not in connection.tables:
        raise GeneralError(f"Table '{table}' doesn't exist")
    return connection.tables[table].frame(connection._db.spark)


def vector_search(connection: Connection, table: str, column: str, vector: list[float], k: int = 10, metric: str = "l2") -> list[dict[str, Any]]:
    """The nearest rows with their distance, exactly."""
    if metric not in ("l2", "cosine", "dot"):
        raise GeneralError(f"unknown metric {metric!r}")
    df = _table_and_key(connection, table)
    near = search.nearest(df, "_rowid", column, vector, max(1, min(k, MOST_K)), metric)
    rows = near.join(df, "_rowid").orderBy("distance", "_rowid").drop("_rowid")
    return [r.asDict() for r in rows.collect()]


def bm25_search(connection: Connection, table: str, column: str, text: str, k: int = 10) -> list[dict[str, Any]]:
    """The best rows for a text with their score; the column needs a full-text index."""
    df = _table_and_key(connection, table)
    if not any(i.using == "fts" and i.column == column for i in connection.tables[table].indexes):
        raise GeneralError(f"column '{column}' has no FTS index")
    best = search.bm25_top(df, "_rowid", column, text, max(1, min(k, MOST_K)))
    rows = best.join(df, "_rowid").orderBy(best["score"].desc(), "_rowid").drop("_rowid")
    return [r.asDict() for r in rows.collect()]
