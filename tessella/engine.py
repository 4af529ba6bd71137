"""Tables as immutable versions, and the statements that make new ones.

A version is a list of Parquet files and the declarations.  INSERT adds files; UPDATE
and DELETE rewrite the files that hold a matching row, and keep the others; a
transaction is a copy of the dictionary of versions.  No statement changes a file,
so readers never see half a write, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import Busy, GeneralError, InternalError, NotImplementedFeature
from tessella.functions import json as J
from tessella.functions import text as TX
from tessella.operators import search
from tessella.plans import ast as A
from tessella.plans import binder as B
from tessella.plans.binder import ROWID
from tessella.sources.store import Store

#: The read-only table that lists tables and indexes, and how indexes of constraints are called.
CATALOG, AUTO_INDEX = "tessella_master", "tessella_autoindex"

#: What Spark raises: while it analyses, and while it runs.
SPARK_ERRORS = (PySparkException, Py4JError)

SPARK_TYPES = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(), "json": T.StringType(), "vector": T.ArrayType(T.FloatType(), True), "other": None}


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    column: str
    using: str = "btree"
    unique: bool = False
    metric: str = "l2"
    auto: bool = False

    @property
    def sql(self) -> str:
        using = f" USING {self.using}" if self.using != "btree" else ""
        metric = f" WITH (metric = '{self.metric}')" if self.using == "hnsw" and self.metric != "l2" else ""
        return f"CREATE {'UNIQUE ' if self.unique else ''}INDEX {self.name} ON {self.table}{using} ({self.column}){metric}"


@dataclass(frozen=True)
class Segment:
    """Stored postings of a text column of some data files."""

    column: str
    files: tuple[tuple[str, str, int, int], ...]  # each data file, its name in the postings, its texts, their tokens
    parts: tuple[str, ...]


#: Columns of stored postings.
POSTINGS = "term string, id bigint, file string, length int, tf bigint"


@dataclass(frozen=True)
class Version:
    """A table at one moment."""

    name: str
    columns: tuple[A.ColumnDef, ...]
    files: tuple[str, ...] = ()
    last_rowid: int = 0
    indexes: tuple[Index, ...] = ()
    shape: str = ""  # JSON of Spark types for loaded tables, whose types a declaration can't name
    segments: tuple[Segment, ...] = ()

    @property
    def all_files(self) -> tuple[str, ...]:
        return (*self.files, *[p for s in self.segments for p in s.parts])

    @property
    def by_name(self) -> dict[str, A.ColumnDef]:
        return {c.name: c for c in self.columns}

    @property
    def key(self) -> A.ColumnDef | None:
        return next((c for c in self.columns if c.primary_key), None)

    @property
    def schema(self) -> T.StructType:
        loaded = {f.name: f.dataType for f in T.StructType.fromJson(__import__("json").loads(self.shape)).fields} if self.shape else {}
        fields = []
        for c in self.columns:
            meta = {"logical": c.type} | ({"dim": c.dim} if c.dim else {})
            fields.append(T.StructField(c.name, loaded.get(c.name, SPARK_TYPES[c.type]), True, meta))
        return T.StructType([*fields, T.StructField(ROWID, T.LongType(), True)])

    @property
    def sql(self) -> str:
        return f"CREATE TABLE {self.name} ({', '.join(column_sql(c) for c in self.columns)})"

    def frame(self, spark: SparkSession, files: tuple[str, ...] | None = None) -> DataFrame:
        files = self.files if files is None else files
        if not files:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*files)


def column_sql(c: A.ColumnDef) -> str:
    kind = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "bool": "BOOLEAN", "json": "JSON", "vector": f"VECTOR({c.dim})"}.get(c.type, c.declared)
    out = f"{c.name} {kind}"
    out += " PRIMARY KEY" if c.primary_key else (" NOT NULL" if c.not_null else "") + (" UNIQUE" if c.unique else "")
    return out + (f" DEFAULT {literal_sql(c.default)}" if c.has_default else "")


def literal_sql(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


Tables = dict[str, Version]


@dataclass
class Commit:
    """Rows that a concurrent transaction has changed."""

    at: int
    table: str
    rows: DataFrame  # of one column, the rowid


@dataclass
class Database:
    """State that all handles on a database share."""

    spark: SparkSession
    store: Store
    tables: Tables = field(default_factory=dict)
    snapshot: Tables | None = None  # before BEGIN
    journal: str = "wal"
    auto_vacuum: float | None = 0.25
    clock: int = 0
    commits: list[Commit] = field(default_factory=list)
    active: dict[int, int] = field(default_factory=dict)  # concurrent transactions: id -> begin
    lock: threading.RLock = field(default_factory=threading.RLock)
    handles: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str | None, *, read_only: bool = False) -> Database:
        store = Store(spark, path, read_only=read_only)
        found = cls(spark, store)
        for name, told in ((store.read_manifest() or {}).get("tables") or {}).items():
            columns = tuple(A.ColumnDef(**{**c, "default": tuple(c["default"]) if isinstance(c["default"], list) else c["default"]}) for c in told["columns"])
            found.tables[name] = Version(name, columns, tuple(told["files"]), told["last_rowid"], tuple(Index(**i) for i in told["indexes"]), told["shape"], tuple(Segment(s["column"], tuple(map(tuple, s["files"])), tuple(s["parts"])) for s in told.get("segments", ())))
        return found

    @property
    def read_only(self) -> bool:
        return self.store.read_only

    def publish(self) -> None:
        """Make the current versions those that an open finds."""
        told = {
            t.name: {"columns": [c.__dict__ for c in t.columns], "files": list(t.files), "last_rowid": t.last_rowid, "indexes": [i.__dict__ for i in t.indexes], "shape": t.shape, "segments": [s.__dict__ for s in t.segments]}
            for t in self.tables.values()
        }
        self.store.write_manifest({"format": 1, "tables": told})


class Session:
    """Statements against a dictionary of versions: the live one, or a transaction's own."""

    def __init__(self, db: Database, tables: Tables):
        self.db, self.spark, self.tables = db, db.spark, tables

    # --- names -----------------------------------------------------------

    def table(self, name: str) -> Version:
        if name not in self.tables:
            raise GeneralError(f"Table '{name}' doesn't exist")
        return self.tables[name]

    def writable(self, name: str) -> Version:
        if name == CATALOG:
            raise GeneralError(f"'{CATALOG}' is a reserved name used by the internal schema catalog")
        return self.table(name)

    def catalog(self) -> DataFrame:
        rows = []
        for t in sorted(self.tables.values(), key=lambda t: t.name):
            rows.append(("table", t.name, t.sql, 0, t.last_rowid))
            rows += [("index", i.name, i.sql, 0, 0) for i in t.indexes]
        return self.spark.createDataFrame(rows, "type string, name string, sql string, rootpage long, last_rowid long").coalesce(1)

    def source(self, ref: A.Source, position: int) -> B.Table:
        stored = None
        if ref.table == CATALOG:
            if position:
                raise NotImplementedFeature(f"joining {CATALOG} is not supported")
            raw, fts, rowid = self.catalog(), lambda c: False, None
        else:
            version = self.table(ref.table)
            stored = lambda column, query: self.stored_scores(version, column, query)
            raw, rowid = version.frame(self.spark), ROWID
            with_fts = {i.column for i in version.indexes if i.using == "fts"}
            fts = with_fts.__contains__
        names = {f.name: f"_t{position}_{k}" for k, f in enumerate(raw.schema.fields)}
        df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        kinds = {f.name: B.kind_of(f) for f in raw.schema.fields}
        inner = names.pop(ROWID) if rowid else None
        return B.Table(ref.scope, df, names, kinds, fts, raw, inner, stored)

    # --- stored postings -----------------------------------------------------

    def indexed(self, table: Version) -> Version:
        """The version with postings of all its files for its full-text indexes; files that have some keep them."""
        live, segments = set(table.files), []
        for column in dict.fromkeys(i.column for i in table.indexes if i.using == "fts"):
            kept = [s for s in table.segments if s.column == column and any(f[0] in live for f in s.files)]
            known = {f[0] for s in kept for f in s.files}
            fresh = tuple(f for f in table.files if f not in known)
            segments += [*kept, *([self.segment(table, column, fresh)] if fresh else [])]
        return replace(table, segments=tuple(segments))

    def segment(self, table: Version, column: str, files: tuple[str, ...]) -> Segment:
        """Write the postings of some files of a table, ranged by term."""
        rows = table.frame(self.spark, files).withColumn("_file", F.input_file_name()).select(F.col(ROWID).alias("id"), F.col("_file").alias("file"), F.col(f"`{column}`").alias("text"))
        folder = self.db.store.new_folder(f"{table.name}-postings")
        search.postings(rows, "id", "text", "file").select("term", "id", "file", "length", "tf").write.parquet(folder)
        sums = rows.groupBy("file").agg(F.count("*").alias("docs"), F.sum(TX.length(F.col("text"))).cast("long").alias("tokens")).collect()  # a row a file
        told = {canonical(r["file"]): (r["file"], r["docs"], r["tokens"]) for r in sums}
        return Segment(column, tuple((f, *told.get(canonical(f), ("", 0, 0))) for f in files), tuple(self.db.store.files_of(folder)))

    def stored_scores(self, table: Version, column: str, query: str) -> DataFrame | None:
        """id and score of the rows that match, from stored postings; None unless they cover all files of the version."""
        live = set(table.files)
        mine = [s for s in table.segments if s.column == column]
        known = [f for s in mine for f in s.files if f[0] in live]
        parts = [p for s in mine for p in s.parts]
        if not parts or {f[0] for f in known} != live:
            return None
        index = self.spark.read.schema(POSTINGS).parquet(*parts)
        gone = [f[1] for s in mine for f in s.files if f[0] not in live and f[1]]  # files that were rewritten since
        if gone:
            index = index.filter(~F.col("file").isin(gone))
        docs, tokens = sum(f[2] for f in known), sum(f[3] for f in known)
        return search.scores(index, docs, tokens / docs if docs else 0.0, query)

    # --- queries -----------------------------------------------------------

    def select(self, query: A.Select, params: list[Any] | None = None) -> DataFrame:
        if query.joins and any(s.table == CATALOG for s in (query.source, *[j.source for j in query.joins])):
            raise NotImplementedFeature(f"joining {CATALOG} is not supported")
        return B.Selection(query, self.source, params).frame()

    # --- writing ------------------------------------------------------------

    def write(self, table: Version, rows: DataFrame) -> tuple[str, ...]:
        """Write rows as new files of a table, in the order of its columns."""
        folder = self.db.store.new_folder(table.name)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields]).write.parquet(folder)
        return tuple(self.db.store.files_of(folder))

    def value(self, c: A.ColumnDef, given: Any) -> Any:
        """A literal as a value of a column."""
        if given is None:
            if c.not_null and not (c.primary_key and c.type == "int"):
                raise GeneralError(f"NOT NULL constraint failed: {c.name}")
            return None
        fits = {
            "int": lambda v: type(v) is int and -(1 << 63) <= v < 1 << 63, "real": lambda v: type(v) in (int, float), "text": lambda v: isinstance(v, str), "bool": lambda v: isinstance(v, bool),
            "json": lambda v: isinstance(v, str), "vector": lambda v: isinstance(v, tuple | list), "other": lambda v: True,
        }
        if not fits[c.type](given):
            raise GeneralError(f"type mismatch for column '{c.name}': {given!r} is not {c.declared}")
        if c.type == "json" and not J.valid(given):
            raise GeneralError(f"column '{c.name}': not valid JSON")
        if c.type == "vector":
            if len(given) != c.dim:
                raise GeneralError(f"column '{c.name}': expected a vector of {c.dim}, got {len(given)}")
            return [float(x) for x in given]
        return float(given) if c.type == "real" else given

    def insert(self, s: A.Insert, params: list[Any] | None = None) -> int:
        table = self.writable(s.table)
        columns = table.by_name
        if len(set(s.columns)) != len(s.columns):
            raise GeneralError("a column is named twice")
        for name in s.columns:
            if name not in columns:
                raise GeneralError(f"Column '{name}' doesn't exist in table '{s.table}'")
        key, last, rows = table.key, table.last_rowid, []
        for given in s.rows:
            if len(given) != len(s.columns):
                raise GeneralError(f"{len(s.columns)} columns but {len(given)} values")
            values = dict(zip(s.columns, [constant(v, params) for v in given], strict=True))
            row = {c.name: self.value(c, values[c.name]) if c.name in values else self.omitted(c) for c in table.columns}
            if key is not None:
                if row[key.name] is None:
                    if key.name in values:
                        raise GeneralError(f"PRIMARY KEY '{key.name}' can't be NULL")
                    row[key.name] = last + 1
                rowid = row[key.name]
            else:
                rowid = last + 1
            last = max(last, rowid)
            rows.append((*[row[c.name] for c in table.columns], rowid))
        self.check_batch(table, rows)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema.fields])
        files = self.write(table, self.spark.createDataFrame(rows, schema))
        self.tables[table.name] = replace(table, files=table.files + files, last_rowid=last)
        return len(rows)

    def omitted(self, c: A.ColumnDef) -> Any:
        if c.has_default:
            return self.value(c, c.default)
        if c.not_null and not (c.primary_key and c.type == "int"):
            raise GeneralError(f"NOT NULL constraint failed: {c.name}")
        return None

    def unique_columns(self, table: Version) -> list[str]:
        named = [c.name for c in table.columns if c.unique] + [i.column for i in table.indexes if i.unique]
        return list(dict.fromkeys(named))

    def check_batch(self, table: Version, rows: list[tuple]) -> None:
        """Unique columns of literal rows: among themselves, then against the table by a filter that reaches the scan."""
        names = [c.name for c in table.columns]
        for name in self.unique_columns(table):
            at = names.index(name)
            values = [r[at] for r in rows if r[at] is not None]
            if len(set(values)) != len(values):
                raise GeneralError(f"UNIQUE constraint failed: {table.name}.{name}")
            if not values or not table.files:
                continue
            frame = table.frame(self.spark)
            col = F.col(f"`{name}`")
            if len(values) <= 1000:
                taken = frame.filter(col.isin(values))
            else:
                batch = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("_v", table.schema[name].dataType)]))
                taken = frame.join(batch, col == F.col("_v"), "left_semi")
            if not taken.isEmpty():
                raise GeneralError(f"UNIQUE constraint failed: {table.name}.{name}")

    def load(self, name: str, df: DataFrame, *, primary_key: str | None = None) -> int:
        """A new table from a DataFrame, written in parallel; for bulk loads of any size."""
        if name in self.tables or name == CATALOG:
            raise GeneralError(f"Cannot create, table '{name}' already exists.")
        columns = []
        for f in df.schema.fields:
            kind = B.kind_of(f)
            if f.name == primary_key and kind != "int":
                raise GeneralError("PRIMARY KEY column must be INTEGER")
            columns.append(A.ColumnDef(f.name, kind, f.dataType.simpleString().upper(), primary_key=f.name == primary_key, unique=f.name == primary_key, not_null=f.name == primary_key))
        rowid = F.col(f"`{primary_key}`").cast("bigint") if primary_key else F.monotonically_increasing_id() + 1
        table = Version(name, tuple(columns), shape=T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]).json(), indexes=self.auto_indexes(name, columns))
        files = self.write(table, df.withColumn(ROWID, rowid))
        told = replace(table, files=files)
        frame = told.frame(self.spark)
        if primary_key and not frame.groupBy(F.col(f"`{primary_key}`")).count().filter("count > 1").isEmpty():
            raise GeneralError(f"UNIQUE constraint failed: {name}.{primary_key}")
        row = frame.agg(F.max(ROWID), F.count("*")).first()
        self.tables[name] = replace(told, last_rowid=row[0] or 0)
        return row[1]


    def matching_files(self, table: Version, scope: A.Source, where: Any, params: list[Any] | None) -> tuple[tuple[str, ...], int]:
        """Files with a matching row, and the number of such rows; only the columns of the condition are read."""
        source = self.source(A.Source(table.name, scope.alias), 0)
        binder = B.Binder([source], params)
        df = source.df.withColumn("_file", F.input_file_name()) if table.files else source.df.withColumn("_file", F.lit(""))
        if where is not None:
            df = df.filter(binder.truth(where))
        found = df.groupBy("_file").agg(F.count("*").alias("n")).collect()  # a row a file
        named = {canonical(f): f for f in table.files}
        return tuple(named[canonical(r["_file"])] for r in found), sum(r["n"] for r in found)

    def delete(self, s: A.Delete, params: list[Any] | None = None) -> int:
        table = self.writable(s.source.table)
        files, n = self.matching_files(table, s.source, s.where, params)
        if not n:
            return 0
        kept = tuple(f for f in table.files if f not in set(files))
        if s.where is None:
            self.tables[table.name] = replace(table, files=())
            return n
        part = replace(table, files=files)
        old = Session(self.db, {table.name: part}).source(A.Source(table.name, s.source.alias), 0)
        gone = F.coalesce(B.Binder([old], params).truth(s.where), F.lit(False))
        rest = old.df.filter(~gone).select(*[F.col(n).alias(c) for c, n in old.columns.items()], F.col(old.rowid).alias(ROWID))
        new = self.write(table, rest)
        self.tables[table.name] = replace(table, files=kept + new)
        return n

    def update(self, s: A.Update, params: list[Any] | None = None) -> int:
        table = self.writable(s.source.table)
        columns = table.by_name
        for name, _ in s.sets:
            if name not in columns:
                raise GeneralError(f"Column '{name}' doesn't exist in table '{table.name}'")
        files, n = self.matching_files(table, s.source, s.where, params)
        part = replace(table, files=files)
        old = Session(self.db, {table.name: part}).source(A.Source(table.name, s.source.alias), 0)
        whole = self.source(A.Source(table.name, s.source.alias), 0)
        old.raw = whole.raw  # full-text scores are of the whole table
        binder = B.Binder([old], params)
        hit = F.coalesce(binder.truth(s.where), F.lit(False)) if s.where is not None else F.lit(True)
        values: dict[str, Any] = {}
        for name, e in s.sets:
            col = self.assigned(columns[name], e, binder, params)
            values[name] = F.when(hit, col).otherwise(F.col(old.columns[name]))
        if not n:
            return 0
        key = table.key
        rowid = values[key.name] if key is not None and key.name in values else F.col(old.rowid)
        fresh = old.df.select(*[values.get(c, F.col(i)).alias(c) for c, i in old.columns.items()], rowid.alias(ROWID), hit.alias("_hit"))
        new = self.write(table, fresh)
        kept = tuple(f for f in table.files if f not in set(files))
        told = replace(table, files=kept + new)
        for name in [u for u in self.unique_columns(table) if u in values]:
            col = F.col(f"`{name}`")
            mine = table.frame(self.spark, new).filter(col.isNotNull())
            again = mine.groupBy(col).count().filter("count > 1")
            other = mine.join(table.frame(self.spark, kept).select(col.alias("_v")), col == F.col("_v"), "left_semi") if kept else None
            if not again.isEmpty() or other is not None and not other.isEmpty():
                raise GeneralError(f"UNIQUE constraint failed: {table.name}.{name}")
        if key is not None and key.name in values:
            told = replace(told, last_rowid=max(told.last_rowid, told.frame(self.spark).agg(F.max(ROWID)).first()[0] or 0))
        self.tables[table.name] = told
        return n

    def assigned(self, c: A.ColumnDef, e: Any, binder: B.Binder, params) -> Any:
        """The right side of SET as a value of a column."""
        plain = e.value if isinstance(e, A.Literal) else params[e.index] if isinstance(e, A.Param) and params else None
        if isinstance(e, A.Literal) or isinstance(e, A.Param) and params:
            value = self.value(c, plain)
            if value is None and c.primary_key:
                raise GeneralError(f"PRIMARY KEY '{c.name}' can't be NULL")
            return F.lit(None) if value is None else B.literal(value)[0]
        col, kind = binder.lower(e)
        allowed = {"int": ("int",), "real": ("int", "real"), "text": ("text", "json", "node"), "bool": ("bool",), "json": ("json",), "vector": ("vector",)}.get(c.type, ("other",))
        if kind not in (*allowed, "null"):
            raise GeneralError(f"type mismatch for column '{c.name}': {kind} is not {c.declared}")
        if c.not_null:
            col = F.coalesce(col, F.raise_error(F.lit(f"NOT NULL constraint failed: {c.name}")))
        if c.type == "vector":
            col = F.when(F.size(col) == c.dim, col).otherwise(F.raise_error(F.lit(f"column '{c.name}': expected a vector of {c.dim}")))
        return col

    # --- declarations -----------------------------------------------------------

    def auto_indexes(self, table: str, columns) -> tuple[Index, ...]:
        return tuple(Index(f"{AUTO_INDEX}_{table}_{c.name}", table, c.name, unique=True, auto=True) for c in columns if c.unique and c.type in ("int", "text"))

    def create_table(self, s: A.CreateTable) -> str:
        if s.table == CATALOG:
            raise GeneralError(f"'{CATALOG}' is a reserved name used by the internal schema catalog")
        if s.table in self.tables:
            if s.if_not_exists:
                return f"CREATE TABLE Statement executed. (table '{s.table}' already exists, no-op)"
            raise GeneralError("Cannot create, table already exists.")
        names = [c.name for c in s.columns]
        for name in names:
            if names.count(name) > 1:
                raise GeneralError(f"Column '{name}' appears more than once in the table definition")
            if name == ROWID:
                raise GeneralError(f"'{ROWID}' is a reserved name")
        if sum(c.primary_key for c in s.columns) > 1:
            raise GeneralError("a table has one PRIMARY KEY at most")
        for c in s.columns:
            if c.primary_key and c.type != "int":
                raise GeneralError("PRIMARY KEY column must be INTEGER")
            if c.has_default and c.default is not None:
                self.value(c, c.default)
        columns = tuple(replace(c, unique=c.unique and c.type not in ("real", "bool")) for c in s.columns)
        self.tables[s.table] = Version(s.table, columns, indexes=self.auto_indexes(s.table, columns))
        return "CREATE TABLE Statement executed."

    def create_index(self, s: A.CreateIndex) -> str:
        table = self.writable(s.table)
        if any(i.name == s.name for i in table.indexes):
            if s.if_not_exists:
                return "CREATE INDEX Statement executed."
            raise GeneralError(f"index '{s.name}' already exists")
        if s.column not in table.by_name:
            raise GeneralError(f"Column '{s.column}' doesn't exist in table '{s.table}'")
        kind = table.by_name[s.column].type
        wanted = {"btree": ("int", "text"), "hnsw": ("vector",), "fts": ("text",)}[s.using]
        if kind not in wanted:
            raise GeneralError(f"a {s.using} index needs a column of type {' or '.join(wanted)}, and '{s.column}' is {kind}")
        if s.unique and s.using != "btree":
            raise GeneralError(f"UNIQUE has no meaning for a {s.using} index")
        if s.unique:
            col = F.col(f"`{s.column}`")
            if not table.frame(self.spark).filter(col.isNotNull()).groupBy(col).count().filter("count > 1").isEmpty():
                raise GeneralError(f"UNIQUE constraint failed: {s.table}.{s.column} has equal values")
        index = Index(s.name, s.table, s.column, s.using, s.unique, s.metric)
        self.tables[s.table] = replace(table, indexes=(*table.indexes, index))
        return "CREATE INDEX Statement executed."

    def drop(self, s: A.Drop) -> int:
        if s.kind == "table":
            if s.name == CATALOG:
                raise GeneralError(f"'{CATALOG}' is a reserved name used by the internal schema catalog")
            if s.name not in self.tables:
                if s.if_exists:
                    return 0
                raise GeneralError(f"Table '{s.name}' doesn't exist")
            del self.tables[s.name]
            return 1
        for table in self.tables.values():
            for index in table.indexes:
                if index.name == s.name:
                    if index.auto:
                        raise GeneralError(f"index '{s.name}' belongs to a constraint and can't be dropped")
                    self.tables[table.name] = replace(table, indexes=tuple(i for i in table.indexes if i is not index))
                    return 1
        if s.if_exists:
            return 0
        raise GeneralError(f"index '{s.name}' doesn't exist")

    def alter(self, s: A.Alter) -> None:
        if s.table == CATALOG or s.new == CATALOG:
            raise GeneralError(f"'{CATALOG}' is a reserved name used by the internal schema catalog")
        if s.table not in self.tables:
            if s.if_exists:
                return
            raise GeneralError(f"Table '{s.table}' doesn't exist")
        table = self.tables[s.table]
        match s.action:
            case "rename":
                if s.new in self.tables:
                    raise GeneralError(f"table '{s.new}' already exists")
                indexes = tuple(replace(i, table=s.new, name=f"{AUTO_INDEX}_{s.new}_{i.column}" if i.auto else i.name) for i in table.indexes)
                del self.tables[s.table]
                self.tables[s.new] = replace(table, name=s.new, indexes=indexes)
            case "rename_column":
                self.need_column(table, s.old)
                if s.new in table.by_name or s.new == ROWID:
                    raise GeneralError(f"column '{s.new}' already exists")
                indexes = tuple(replace(i, column=s.new, name=f"{AUTO_INDEX}_{table.name}_{s.new}" if i.auto else i.name) if i.column == s.old else i for i in table.indexes)
                columns = tuple(replace(c, name=s.new) if c.name == s.old else c for c in table.columns)
                told = replace(table, columns=columns, indexes=indexes, shape=reshaped(table.shape, {s.old: s.new}))
                self.rewrite(table, told, table.frame(self.spark).withColumnRenamed(s.old, s.new))
            case "add_column":
                c = s.column
                if c.name in table.by_name or c.name == ROWID:
                    if s.column_guard:
                        return
                    raise GeneralError(f"column '{c.name}' already exists")
                if c.primary_key or c.unique:
                    raise GeneralError("ADD COLUMN takes no PRIMARY KEY or UNIQUE column")
                default = self.value(c, c.default) if c.has_default and c.default is not None else None
                filled = bool(table.files) and not table.frame(self.spark).isEmpty()
                if c.not_null and default is None and filled:
                    raise GeneralError("a NOT NULL column needs a DEFAULT where the table has rows")
                told = replace(table, columns=(*table.columns, c))
                if filled and default is not None:
                    self.rewrite(table, told, table.frame(self.spark).withColumn(c.name, B.literal(default)[0]))
                else:  # files without the column read as NULL
                    self.tables[table.name] = told
            case "drop_column":
                if s.old not in table.by_name and s.column_guard:
                    return
                self.need_column(table, s.old)
                if table.by_name[s.old].primary_key:
                    raise GeneralError("the PRIMARY KEY column can't be dropped")
                if len(table.columns) == 1:
                    raise GeneralError("the only column of a table can't be dropped")
                told = replace(table, columns=tuple(c for c in table.columns if c.name != s.old), indexes=tuple(i for i in table.indexes if i.column != s.old))
                # rewritten, so that a later column of the same name doesn't find old values
                self.rewrite(table, told, table.frame(self.spark).drop(s.old))

    def need_column(self, table: Version, name: str) -> None:
        if name not in table.by_name:
            raise GeneralError(f"Column '{name}' doesn't exist in table '{table.name}'")

    def rewrite(self, old: Version, told: Version, rows: DataFrame) -> None:
        self.tables[told.name] = replace(told, files=self.write(told, rows) if old.files else ())


def reshaped(shape: str, names: dict[str, str]) -> str:
    if not shape:
        return shape
    fields = T.StructType.fromJson(__import__("json").loads(shape)).fields
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in fields]).json()


def canonical(path: str) -> str:
    """A file's path however Spark or Hadoop writes it."""
    from urllib.parse import unquote

    scheme, colon, rest = path.partition(":")
    return unquote(f"{scheme}:/{rest.lstrip('/')}" if colon else path)


def constant(e: Any, params: list[Any] | None) -> Any:
    """The value of a literal of VALUES, with its sign."""
    if isinstance(e, A.Param):
        if params is None or e.index >= len(params):
            raise GeneralError(f"parameter {e.index + 1} has no value")
        return params[e.index]
    if isinstance(e, A.Literal):
        return e.value
    if isinstance(e, A.Unary) and e.op in "+-":
        value = constant(e.operand, params)
        if type(value) in (int, float):
            return -value if e.op == "-" else value
    raise NotImplementedFeature("VALUES takes literals only")


def mapped(error: Exception) -> Exception:
    """A failure inside Spark as an error of the engine."""
    text = str(error)
    for line in text.splitlines():
        if "USER_RAISED_EXCEPTION" in line:
            return GeneralError(line.split("USER_RAISED_EXCEPTION]", 1)[-1].split("SQLSTATE")[0].strip())
    for line in text.splitlines():
        if any(k in line for k in ("ARITHMETIC_OVERFLOW", "CAST_INVALID_INPUT", "DIVIDE_BY_ZERO", "DATATYPE_MISMATCH")):
            return GeneralError(line.split(": ", 1)[-1].split("SQLSTATE")[0].strip())
    return InternalError(text.splitlines()[0] if text else repr(error))


# --- concurrent transactions -----------------------------------------------------


@dataclass
class ConcurrentTx:
    """A private copy of the versions, and the moment it was taken."""

    id: int
    begin: int
    base: Tables
    tables: Tables


def write_set(db: Database, old: Version, new: Version) -> tuple[DataFrame, DataFrame]:
    """Rowids that differ between two versions of a table, and the new rows; only files that aren't in both are read."""
    before = old.frame(db.spark, tuple(f for f in old.files if f not in set(new.files)))
    after = new.frame(db.spark, tuple(f for f in new.files if f not in set(old.files)))
    names = [f"`{c.name}`" for c in new.columns]
    whole = F.to_json(F.struct(*names))  # NULLs are left out, so equal text means equal rows
    a = before.select(F.col(ROWID).alias("ra"), whole.alias("a"))
    b = after.select(F.col(ROWID).alias("rb"), whole.alias("b"))
    changed = a.join(b, F.col("ra") == F.col("rb"), "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("ra", "rb").alias(ROWID))
    return changed, after.join(changed, ROWID, "left_semi")


def commit_concurrent(db: Database, tx: ConcurrentTx) -> None:
    """First committer wins: rows that another transaction has committed since `begin` make this one Busy."""
    if {n: (t.columns, t.indexes) for n, t in db.tables.items()} != {n: (t.columns, t.indexes) for n, t in tx.base.items()}:
        raise Busy("the schema has changed since the transaction began")
    live = Session(db, dict(db.tables))
    log: list[tuple[str, DataFrame]] = []
    for name, new in tx.tables.items():
        old = tx.base[name]
        if old.files == new.files:
            continue
        rows, fresh = write_set(db, old, new)
        folder = db.store.new_folder(f"{name}-changes")
        rows.write.parquet(folder)
        rows = db.spark.read.parquet(folder)
        for other in db.commits:
            if other.table == name and other.at > tx.begin and not rows.join(other.rows, ROWID, "left_semi").isEmpty():
                raise Busy(f"a row of '{name}' was changed by another transaction: retry")
        now = db.tables[name]
        if now.files == old.files:  # nothing else was committed: the private version is the new one
            live.tables[name] = new
        else:
            frame = now.frame(db.spark).withColumn("_file", F.input_file_name())
            hit = {canonical(r[0]) for r in frame.join(rows, ROWID, "left_semi").select("_file").distinct().collect()}
            touched = tuple(f for f in now.files if canonical(f) in hit)
            rest = now.frame(db.spark, touched).join(rows, ROWID, "left_anti")
            files = live.write(now, rest.unionByName(fresh))
            told = replace(now, files=tuple(f for f in now.files if f not in set(touched)) + files, last_rowid=max(now.last_rowid, new.last_rowid))
            taken = live.unique_columns(now)
            for column in taken:  # only what is new can meet a value that is taken
                col = F.col(f"`{column}`")
                mine = fresh.filter(col.isNotNull()).select(col)
                others = now.frame(db.spark).join(rows, ROWID, "left_anti").select(col.alias("_v"))
                if not mine.groupBy(col).count().filter("count > 1").isEmpty() or not mine.join(others, col == F.col("_v"), "left_semi").isEmpty():
                    raise Busy(f"a value of '{name}.{column}' was taken by another transaction: retry")
            live.tables[name] = live.indexed(told)
        log.append((name, rows))
    db.clock += 1
    db.commits += [Commit(db.clock, name, rows) for name, rows in log]
    db.tables = live.tables
    db.publish()


def collect_garbage(db: Database) -> None:
    """Forget commits that no open transaction can conflict with."""
    oldest = min(db.active.values(), default=db.clock)
    db.commits = [c for c in db.commits if c.at > oldest]
