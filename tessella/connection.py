"""Connections, prepared statements, rows, and a DB-API cursor."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessella import engine as E
from tessella.errors import Busy, EngineError, GeneralError, NotImplementedFeature
from tessella.plans import ast as A
from tessella.plans.lexer import tokens
from tessella.plans.parser import parse

_IDS = itertools.count(1)
READ_ONLY = "cannot execute: database is opened read-only"
WRITES = (A.Insert, A.Update, A.Delete, A.CreateTable, A.CreateIndex, A.Drop, A.Alter)
DECLARES = (A.CreateTable, A.CreateIndex, A.Drop, A.Alter)


@dataclass(frozen=True)
class Output:
    """A status line, and for a query its rows as a text table."""

    status: str
    rendered: str | None = None


class Row:
    """One row; by position, by name, and converted."""

    def __init__(self, columns: list[str], values: tuple):
        self.columns, self.values = columns, values

    def get(self, index: int, kind: type | None = None) -> Any:
        if not 0 <= index < len(self.values):
            raise GeneralError(f"no column {index}")
        value = self.values[index]
        if kind is None or value is None or type(value) is kind:
            return value
        if kind is float and type(value) is int:
            return float(value)
        if kind is bool and type(value) is int:
            return value != 0
        if kind is str and not isinstance(value, list):
            return str(value)
        raise GeneralError(f"column {index} holds {type(value).__name__}, not {kind.__name__}")

    def get_by_name(self, name: str, kind: type | None = None) -> Any:
        if name not in self.columns:
            raise GeneralError(f"no column '{name}'")
        return self.get(self.columns.index(name), kind)

    def __getitem__(self, key: int | str) -> Any:
        return self.get(key) if isinstance(key, int) else self.get_by_name(key)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.values)

    def __len__(self) -> int:
        return len(self.values)


class Rows:
    """The result of a query: a DataFrame, and an iterator over it that streams partition by partition."""

    def __init__(self, df: DataFrame):
        self.df, self.columns, self._rows = df, df.columns, None

    def __iter__(self) -> Iterator[Row]:
        while (row := self.next()) is not None:
            yield row

    def next(self) -> Row | None:
        try:
            if self._rows is None:
                self._rows = self.df.toLocalIterator()
            found = next(self._rows, None)
        except E.SPARK_ERRORS as e:
            raise E.mapped(e) from e
        return None if found is None else Row(self.columns, tuple(found))

    def collect_all(self) -> list[Row]:
        return list(self)


class Statement:
    """A parsed statement that takes parameters each time it runs."""

    def __init__(self, connection: Connection, sql: str):
        self.connection, self.sql, self.parsed = connection, sql, parse(sql)

    @property
    def parameter_count(self) -> int:
        return self.parsed.params

    @property
    def column_names(self) -> None:
        """Known only once it has run."""
        return None

    def _checked(self, params: Sequence[Any]) -> list[Any]:
        if len(params) != self.parameter_count:
            raise GeneralError(f"the statement has {self.parameter_count} parameters, and {len(params)} were given")
        return list(params)

    def run(self) -> str:
        return self.execute_with_params([])

    def execute_with_params(self, params: Sequence[Any]) -> str:
        return self.connection._run(self.parsed.statement, self._checked(params)).status

    def query(self) -> Rows:
        return self.query_with_params([])

    def query_with_params(self, params: Sequence[Any]) -> Rows:
        given = self._checked(params)
        if not isinstance(self.parsed.statement, A.Select | A.Pragma):
            raise GeneralError("only SELECT and PRAGMA can be queried")
        return self.connection._query(self.parsed.statement, given)


class Connection:
    """A handle on a database.  Handles of :meth:`connect` share its state, each with a concurrent transaction of its own."""

    def __init__(self, db: E.Database):
        self._db, self._tx, self._cache, self._capacity, self._open = db, None, OrderedDict(), 16, True
        db.handles += 1

    @classmethod
    def open(cls, path: str, spark: SparkSession | None = None) -> Connection:
        return cls(E.Database.open(spark or _session(), path))

    @classmethod
    def open_read_only(cls, path: str, spark: SparkSession | None = None) -> Connection:
        return cls(E.Database.open(spark or _session(), path, read_only=True))

    @classmethod
    def open_in_memory(cls, spark: SparkSession | None = None) -> Connection:
        return cls(E.Database.open(spark or _session(), None))

    def connect(self) -> Connection:
        """Another handle on the same database."""
        return Connection(self._db)

    def close(self) -> None:
        if self._open:
            self._open = False
            self._end_tx()
            self._db.handles -= 1
            if not self._db.handles:
                self._db.store.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    # --- state ----------------------------------------------------------------

    def handle_count(self) -> int:
        return self._db.handles

    def in_transaction(self) -> bool:
        return self._db.snapshot is not None

    def concurrent_tx_is_open(self) -> bool:
        return self._tx is not None

    def is_read_only(self) -> bool:
        return self._db.read_only

    def journal_mode(self) -> str:
        return self._db.journal

    def auto_vacuum_threshold(self) -> float | None:
        return self._db.auto_vacuum

    def set_auto_vacuum_threshold(self, share: float | None) -> None:
        if share is not None and not 0 <= share <= 1:
            raise GeneralError("auto_vacuum takes a share from 0 to 1")
        self._db.auto_vacuum = share

    def vacuum_mvcc(self) -> int:
        """Forget commits that no open transaction needs; how many."""
        before = len(self._db.commits)
        E.collect_garbage(self._db)
        return before - len(self._db.commits)

    @property
    def tables(self) -> dict[str, E.Version]:
        return self._tx.tables if self._tx else self._db.tables

    # --- statements -------------------------------------------------------------

    def execute(self, sql: str) -> str:
        """Run one statement; its status line."""
        return self.execute_with_render(sql, render=False).status

    def execute_with_render(self, sql: str, *, render: bool = True) -> Output:
        parsed = parse(sql)
        if parsed.params:
            raise GeneralError("the statement has parameters: prepare it")
        return self._run(parsed.statement, None, render)

    def prepare(self, sql: str) -> Statement:
        return Statement(self, sql)

    def prepare_cached(self, sql: str) -> Statement:
        """As :meth:`prepare`, from a cache of the last statements by their text."""
        if sql in self._cache:
            self._cache.move_to_end(sql)
            return self._cache[sql]
        found = Statement(self, sql)
        if self._capacity:
            self._cache[sql] = found
            while len(self._cache) > self._capacity:
                self._cache.popitem(last=False)
        return found

    def set_prepared_cache_capacity(self, capacity: int) -> None:
        self._capacity = capacity
        while len(self._cache) > capacity:
            self._cache.popitem(last=False)

    def query(self, sql: str) -> Rows:
        return self.prepare(sql).query()

    def load(self, name: str, df: DataFrame, *, primary_key: str | None = None) -> int:
        """A new table from a DataFrame of any size; the number of its rows."""
        return self._write(lambda s: s.load(name, df, primary_key=primary_key), declares=True)

    def cursor(self) -> Cursor:
        return Cursor(self)

    # --- running ------------------------------------------------------------------

    def _query(self, statement: Any, params: list[Any] | None) -> Rows:
        with self._db.lock:
            try:
                df = self._pragma(statement)[1] if isinstance(statement, A.Pragma) else E.Session(self._db, self.tables).select(statement, params)
            except E.SPARK_ERRORS as e:
                raise E.mapped(e) from e
            if df is None:
                raise GeneralError("the PRAGMA has no result")
            return Rows(df)

    def _write(self, action, *, declares: bool) -> Any:
        db = self._db
        with db.lock:
            if db.read_only:
                raise GeneralError(READ_ONLY)
            if self._tx and declares:
                raise NotImplementedFeature("declarations inside BEGIN CONCURRENT are not supported")
            session = E.Session(db, dict(self.tables))  # a statement that fails changes nothing
            try:
                found = action(session)
                session.tables = {n: t if t is self.tables.get(n) else session.indexed(t) for n, t in session.tables.items()}
            except E.SPARK_ERRORS as e:
                raise E.mapped(e) from e
            if self._tx:
                self._tx.tables = session.tables
            else:
                db.tables = session.tables
                if db.snapshot is None:
                    db.publish()
            return found

    def _run(self, s: Any, params: list[Any] | None, render: bool = False) -> Output:
        plural = lambda n: "" if n == 1 else "s"
        match s:
            case None:
                return Output("")
            case A.Select():
                rows = self._query(s, params)
                if not render:
                    try:
                        n = rows.df.count()
                    except E.SPARK_ERRORS as e:
                        raise E.mapped(e) from e
                    return Output(f"SELECT Statement executed. {n} row{plural(n)} returned.")
                found = rows.collect_all()
                return Output(f"SELECT Statement executed. {len(found)} row{plural(len(found))} returned.", render_table(rows.columns, found))
            case A.Pragma():
                status, df = self._pragma(s)
                return Output(status, render_table(df.columns, [Row(df.columns, tuple(r)) for r in df.collect()]) if df is not None and render else None)
            case A.Plain():
                return Output(getattr(self, "_" + s.kind.replace(" ", "_"))())
            case A.Insert():
                self._write(lambda w: w.insert(s, params), declares=False)
                return Output("INSERT Statement executed.")
            case A.Update():
                n = self._write(lambda w: w.update(s, params), declares=False)
                return Output(f"UPDATE Statement executed. {n} row{plural(n)} updated.")
            case A.Delete():
                n = self._write(lambda w: w.delete(s, params), declares=False)
                return Output(f"DELETE Statement executed. {n} row{plural(n)} deleted.")
            case A.CreateTable():
                return Output(self._write(lambda w: w.create_table(s), declares=True))
            case A.CreateIndex():
                return Output(self._write(lambda w: w.create_index(s), declares=True))
            case A.Drop():
                n = self._write(lambda w: w.drop(s), declares=True)
                self._maybe_vacuum()
                noun = {"table": ("table", "tables"), "index": ("index", "indexes")}[s.kind][n != 1]
                return Output(f"DROP {s.kind.upper()} Statement executed. {n} {noun} dropped.")
            case A.Alter():
                self._write(lambda w: w.alter(s), declares=True)
                if s.action == "drop_column":
                    self._maybe_vacuum()
                return Output("ALTER TABLE Statement executed.")
        raise NotImplementedFeature(f"statement {type(s).__name__} is not supported")

    # --- transactions ---------------------------------------------------------------

    def _begin(self) -> str:
        db = self._db
        with db.lock:
            if db.read_only:
                raise GeneralError(READ_ONLY)
            if db.snapshot is not None or self._tx:
                raise GeneralError("a transaction is already open")
            db.snapshot = dict(db.tables)
        return "BEGIN"

    def _begin_concurrent(self) -> str:
        db = self._db
        with db.lock:
            if db.read_only:
                raise GeneralError(READ_ONLY)
            if db.journal != "mvcc":
                raise GeneralError("BEGIN CONCURRENT needs PRAGMA journal_mode = mvcc")
            if self._tx or db.snapshot is not None:
                raise GeneralError("a transaction is already open")
            self._tx = E.ConcurrentTx(next(_IDS), db.clock, dict(db.tables), dict(db.tables))
            db.active[self._tx.id] = self._tx.begin
        return "BEGIN"

    def _commit(self) -> str:
        db = self._db
        with db.lock:
            if self._tx:
                try:
                    E.commit_concurrent(db, self._tx)
                finally:  # a transaction that lost is gone
                    self._end_tx()
                return "COMMIT"
            if db.snapshot is None:
                raise GeneralError("no transaction is open")
            try:
                db.publish()
            except Exception as e:
                db.tables, db.snapshot = db.snapshot, None
                raise GeneralError(f"COMMIT failed — transaction rolled back: {e}") from e
            db.snapshot = None
        return "COMMIT"

    def _rollback(self) -> str:
        db = self._db
        with db.lock:
            if self._tx:
                self._end_tx()
                return "ROLLBACK"
            if db.snapshot is None:
                raise GeneralError("no transaction is open")
            db.tables, db.snapshot = db.snapshot, None
        return "ROLLBACK"

    def _end_tx(self) -> None:
        if self._tx:
            self._db.active.pop(self._tx.id, None)
            self._tx = None
            E.collect_garbage(self._db)

    # --- upkeep -------------------------------------------------------------------------

    def _vacuum(self) -> str:
        """Compact tables of many files and delete files that no version refers to."""
        db = self._db
        with db.lock:
            if db.read_only:
                raise GeneralError(READ_ONLY)
            if db.snapshot is not None or self._tx:
                raise GeneralError("VACUUM has to wait until the transaction ends")
            if db.active:  # they still read files that VACUUM would delete
                raise GeneralError("VACUUM has to wait until all concurrent transactions end")
            if db.store.temporary:
                return "VACUUM is a no-op for in-memory databases"
            session = E.Session(db, dict(db.tables))
            for t in list(session.tables.values()):
                if len(t.files) > 1:
                    session.rewrite(t, t, t.frame(db.spark).coalesce(max(1, len(t.files) // 8)))
                    session.tables[t.name] = session.indexed(session.tables[t.name])
            db.tables = session.tables
            db.publish()
            files, size = db.store.vacuum({f for t in db.tables.values() for f in t.all_files})
        return f"VACUUM completed. {files} files reclaimed ({size} bytes)."

    def _maybe_vacuum(self) -> None:
        """After a drop outside transactions: delete dead files if they are a fair share of all."""
        db = self._db
        if db.auto_vacuum is None or db.store.temporary or db.read_only or db.snapshot is not None or self._tx or db.active:
            return
        live = {f for t in db.tables.values() for f in t.all_files}
        fs, where = db.store._hadoop(f"{db.store.path}/data")
        if not fs.exists(where):
            return
        total = sum(1 for d in fs.listStatus(where) for f in fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet"))
        if total >= 16 and total - len(live) > db.auto_vacuum * total:
            db.store.vacuum(live)

    def _pragma(self, s: A.Pragma) -> tuple[str, DataFrame | None]:
        db, spark = self._db, self._db.spark
        one = lambda name, value: spark.createDataFrame([(value,)], f"{name} string").coalesce(1)
        match s.name:
            case "journal_mode":
                if s.value is None:
                    return "PRAGMA journal_mode executed. 1 row returned.", one("journal_mode", db.journal)
                mode = str(s.value).lower()
                if isinstance(s.value, float) or mode not in ("wal", "mvcc"):
                    raise GeneralError(f"unknown journal_mode '{s.value}'")
                if mode == "wal" and db.journal == "mvcc" and (db.commits or db.active):
                    raise GeneralError("journal_mode can't go back to wal while committed versions exist")
                db.journal = mode
                return f"PRAGMA journal_mode set to {mode}.", one("journal_mode", mode)
            case "auto_vacuum":
                if s.value is None:
                    return "PRAGMA auto_vacuum executed. 1 row returned.", one("auto_vacuum", "OFF" if db.auto_vacuum is None else repr(db.auto_vacuum))
                if isinstance(s.value, str):
                    if s.value.upper() not in ("OFF", "NONE"):
                        try:
                            self.set_auto_vacuum_threshold(float(s.value))
                        except ValueError:
                            raise GeneralError(f"auto_vacuum takes a share from 0 to 1, or OFF: {s.value!r}") from None
                    else:
                        self.set_auto_vacuum_threshold(None)
                else:
                    self.set_auto_vacuum_threshold(s.value)
                return "PRAGMA auto_vacuum set.", None
            case "table_list":
                if s.value is not None:
                    raise GeneralError("PRAGMA table_list is read-only")
                rows = [("main", n, "table", len(t.columns), 0, 0) for n, t in sorted(self.tables.items())] + [("main", E.CATALOG, "table", 5, 0, 0)]
                df = spark.createDataFrame(rows, "schema string, name string, type string, ncol long, wr long, strict long").coalesce(1)
                return f"PRAGMA table_list executed. {len(rows)} rows returned.", df
        raise NotImplementedFeature(f"PRAGMA {s.name} is not supported")


class Cursor:
    """DB-API 2.0 cursor."""

    arraysize = 1
    rowcount = -1

    def __init__(self, connection: Connection):
        self.connection, self.description, self._rows = connection, None, None

    def execute(self, sql: str, params: Sequence[Any] = ()) -> Cursor:
        statement = self.connection.prepare_cached(sql)
        self.description = self._rows = None
        if isinstance(statement.parsed.statement, A.Select) or isinstance(statement.parsed.statement, A.Pragma) and statement.parsed.statement.value is None:
            self._rows = statement.query_with_params(params)
            self.description = [(name, None, None, None, None, None, None) for name in self._rows.columns]
        else:
            statement.execute_with_params(params)
        return self

    def executemany(self, sql: str, many: Sequence[Sequence[Any]]) -> Cursor:
        """Run a statement for each row of parameters; an INSERT of one row becomes one INSERT of all of them."""
        statement = self.connection.prepare_cached(sql)
        s = statement.parsed.statement
        if isinstance(s, A.Insert) and len(s.rows) == 1 and many:
            rows = tuple(tuple(A.Literal(E.constant(e, statement._checked(p))) for e in s.rows[0]) for p in many)
            self.connection._run(A.Insert(s.table, s.columns, rows), None)
        else:
            for params in many:
                statement.execute_with_params(params)
        return self

    def executescript(self, script: str) -> Cursor:
        """Run the statements of a script, parted by semicolons, one after another."""
        for sql in split_script(script):
            self.connection.execute(sql)
        return self

    def fetchone(self) -> tuple | None:
        row = self._rows.next() if self._rows else None
        return None if row is None else row.values

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(itertools.islice(iter(self), size or self.arraysize))

    def fetchall(self) -> list[tuple]:
        return list(self)

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.fetchone()) is not None:
            yield row

    def close(self) -> None:
        self._rows = None


def split_script(script: str) -> list[str]:
    """Statements of a script; semicolons in texts and comments don't part them."""
    out, start, i, n = [], 0, 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            end = script.find(c, i + 1)
            i = n if end < 0 else end + 1
        elif script.startswith("--", i):
            end = script.find("\n", i)
            i = n if end < 0 else end + 1
        elif script.startswith("/*", i):
            end = script.find("*/", i)
            i = n if end < 0 else end + 2
        elif c == ";":
            out.append(script[start:i])
            start = i = i + 1
        else:
            i += 1
    return [s for s in [*out, script[start:]] if len(tokens(s)) > 1]


def render_table(columns: list[str], rows: list[Row]) -> str:
    """Rows as a text table."""
    shown = [["NULL" if v is None else str(v) for v in r] for r in rows]
    width = [max([len(c), *[len(r[i]) for r in shown]]) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, width, strict=True)) + "|"
    return "\n".join([rule, line(columns), rule, *[x for r in shown for x in (line(r), rule)]])


def _session() -> SparkSession:
    from tessella.session import local_session

    return SparkSession.getActiveSession() or local_session()


def connect(path: str | None = None, spark: SparkSession | None = None) -> Connection:
    """Open a database folder, or one in memory."""
    return Connection.open(path, spark) if path else Connection.open_in_memory(spark)


__all__ = ["Busy", "Connection", "Cursor", "EngineError", "Output", "Row", "Rows", "Statement", "connect"]
