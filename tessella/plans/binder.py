"""From statements to DataFrames: names, types and lowering of expressions.

Every source column gets an internal name that no other has, so joins are never
ambiguous to Spark.  An expression becomes a Column and its type: int, real, text,
bool, json, vector, other, or null for the NULL literal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import GeneralError, NotImplementedFeature
from tessella.functions import json as J
from tessella.functions import text as TX
from tessella.functions import vector as V
from tessella.operators import search
from tessella.plans import ast as A

ROWID = "_rowid"
NUMERIC = ("int", "real")
Typed = tuple[Column, str]


def sortable(kind: T.DataType) -> bool:
    """Can rows be ordered by values of that type?"""
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType | T.CalendarIntervalType)


def kind_of(field: T.StructField) -> str:
    """The engine's type of a Spark column."""
    logical = (field.metadata or {}).get("logical")
    kind = field.dataType
    if logical:
        return logical
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return "real"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "vector" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else "other"


@dataclass
class Table:
    """A source in scope: what it is called, its data, and its columns' internal names and types."""

    scope: str
    df: DataFrame
    columns: dict[str, str]
    kinds: dict[str, str]
    fts: Callable[[str], bool]
    raw: DataFrame
    rowid: str | None
    stored: Callable[[str, str], DataFrame | None] | None = None  # column, query -> (id, score) from stored postings


class Binder:
    """Names and expressions over the tables in scope."""

    def __init__(self, tables: list[Table], params: list[Any] | None = None):
        self.tables, self.params = tables, params
        self.hidden: set[tuple[int, str]] = set()  # columns that SELECT * shows once only
        self.scored: dict[tuple[str, str], str] | None = None  # scores that a SELECT can join: (column, query) -> name
        self.waiting: list[tuple[str, DataFrame]] = []  # those that it hasn't joined yet

    # --- names -----------------------------------------------------------

    def find(self, name: A.Name) -> tuple[int, str]:
        """Position of the table and column that a name means."""
        if name.qualifier is not None:
            for i, t in enumerate(self.tables):
                if t.scope.lower() == name.qualifier.lower():
                    if name.column not in t.columns:
                        raise GeneralError(f"Column '{name.column}' doesn't exist in table '{t.scope}'")
                    return i, name.column
            raise GeneralError(f"unknown table qualifier '{name.qualifier}'")
        found = [i for i, t in enumerate(self.tables) if name.column in t.columns and (i, name.column) not in self.hidden]
        if not found:
            raise GeneralError(f"unknown column '{name.column}'")
        if len(found) > 1:
            raise GeneralError(f"column '{name.column}' is ambiguous: qualify it as <table>.{name.column}")
        return found[0], name.column

    def column(self, name: A.Name) -> Typed:
        i, column = self.find(name)
        t = self.tables[i]
        return F.col(t.columns[column]), t.kinds[column]

    # --- expressions -------------------------------------------------------

    def lower(self, e: Any) -> Typed:
        match e:
            case A.Literal():
                return literal(e.value)
            case A.Param():
                if self.params is None or e.index >= len(self.params):
                    raise GeneralError(f"parameter {e.index + 1} has no value")
                return literal(self.params[e.index])
            case A.Name():
                return self.column(e)
            case A.Unary():
                return self.unary(e)
            case A.Binary():
                return self.binary(e)
            case A.IsNull():
                col = self.lower(e.operand)[0]
                return (col.isNotNull() if e.negated else col.isNull()), "bool"
            case A.Like():
                return self.like(e)
            case A.InList():
                return self.in_list(e)
            case A.Call():
                return self.call(e)
            case A.Aggregate():
                raise GeneralError(f"aggregate {e.display} is not allowed here: use HAVING, or project it")
        raise NotImplementedFeature(f"expression {e!r} is not supported")

    def truth(self, e: Any) -> Column:
        """An expression as a condition: a whole number is true unless 0."""
        col, kind = self.lower(e)
        return truth(col, kind)

    def unary(self, e: A.Unary) -> Typed:
        if e.op == "NOT":
            col, kind = self.lower(e.operand)
            if kind == "null":
                return F.lit(None).cast("boolean"), "bool"
            if kind != "bool":
                raise GeneralError("NOT needs a condition")
            return ~col, "bool"
        col, kind = self.lower(e.operand)
        if kind not in (*NUMERIC, "null"):
            raise GeneralError(f"unary {e.op} needs a number")
        return (-col if e.op == "-" else col), kind

    def binary(self, e: A.Binary) -> Typed:
        if e.op in ("AND", "OR"):
            a, b = self.truth(e.left), self.truth(e.right)
            return (a & b if e.op == "AND" else a | b), "bool"
        a, b = self.lower(e.left), self.lower(e.right)
        if e.op == "||":
            return F.concat(shown(*a), shown(*b)), "text"
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return compare(e.op, a, b), "bool"
        return arithmetic(e.op, a, b)

    def like(self, e: A.Like) -> Typed:
        text = shown(*self.lower(e.operand))
        pattern = self.params[e.pattern.index] if isinstance(e.pattern, A.Param) and self.params else e.pattern.value if isinstance(e.pattern, A.Literal) else None
        if isinstance(pattern, str):
            found = text.rlike(TX.like_pattern(pattern))
        else:
            found = F.rlike(text, TX.like_column(shown(*self.lower(e.pattern))))
        return (~found if e.negated else found), "bool"

    def in_list(self, e: A.InList) -> Typed:
        left = self.lower(e.operand)
        plain = [i.value for i in e.items if isinstance(i, A.Literal)]
        same = len(plain) == len(e.items) and None not in plain and {literal(v)[1] for v in plain} == {left[1]} and left[1] in ("int", "text")
        found = left[0].isin(plain) if same else reduce(lambda x, y: x | y, [compare("=", left, self.lower(i)) for i in e.items])
        return (~found if e.negated else found), "bool"

    def call(self, e: A.Call) -> Typed:
        if e.name.startswith("vec_distance_"):
            metric = V.METRICS.get(e.name.removeprefix("vec_distance_"))
            if metric is None:
                raise NotImplementedFeature(f"function {e.name} is not supported")
            if len(e.args) != 2:
                raise GeneralError(f"{e.name} takes 2 arguments")
            a, b = (self.lower(x) for x in e.args)
            if a[1] != "vector" or b[1] != "vector":
                raise GeneralError(f"{e.name} needs two vectors")
            sizes = [len(x.value) if isinstance(x, A.Literal) else self.dimension(x) for x in e.args]
            if None not in sizes and sizes[0] != sizes[1]:
                raise GeneralError(f"vector dimensions don't match (lhs={sizes[0]}, rhs={sizes[1]})")
            return metric(a[0], b[0]), "real"
        if e.name in ("json_extract", "json_type", "json_array_length", "json_object_keys"):
            return self.json(e)
        if e.name in ("fts_match", "bm25_score"):
            return self.full_text(e)
        raise NotImplementedFeature(f"function {e.name} is not supported")

    def dimension(self, e: Any) -> int | None:
        if isinstance(e, A.Name):
            i, column = self.find(e)
            field = self.tables[i].raw.schema[column]
            return (field.metadata or {}).get("dim")
        if isinstance(e, A.Param) and self.params and isinstance(self.params[e.index], list | tuple):
            return len(self.params[e.index])
        return None

    def json(self, e: A.Call) -> Typed:
        if len(e.args) not in (1, 2):
            raise GeneralError(f"{e.name} takes 1 or 2 arguments")
        doc, kind = self.lower(e.args[0])
        if kind not in ("json", "text", "null"):
            raise GeneralError(f"{e.name} needs JSON text")
        path = "$"
        if len(e.args) == 2:
            given = e.args[1]
            path = given.value if isinstance(given, A.Literal) else self.params[given.index] if isinstance(given, A.Param) and self.params else None
            if not isinstance(path, str):
                raise GeneralError(f"{e.name} needs a path as a text literal")
        match e.name:
            case "json_extract":
                return J.extract(doc.cast("string"), path), "node"
            case "json_type":
                return J.kind(doc.cast("string"), path), "text"
            case "json_array_length":
                return J.array_length(doc.cast("string"), path), "int"
        return J.object_keys(doc.cast("string"), path), "text"

    def full_text(self, e: A.Call) -> Typed:
        if len(self.tables) > 1:
            raise NotImplementedFeature(f"{e.name} in a join is not supported")
        if len(e.args) != 2 or not isinstance(e.args[0], A.Name):
            raise GeneralError(f"{e.name} takes a column and a text")
        i, column = self.find(e.args[0])
        t = self.tables[i]
        if not t.fts(column):
            raise GeneralError(f"{e.name}: column '{column}' has no FTS index")
        given = e.args[1]
        query = given.value if isinstance(given, A.Literal) else self.params[given.index] if isinstance(given, A.Param) and self.params else None
        if not isinstance(query, str):
            raise GeneralError(f"{e.name} needs a text to search for")
        score = self.stored_score(t, column, query)
        if score is not None:
            return (score.isNotNull(), "bool") if e.name == "fts_match" else (F.coalesce(score, F.lit(0.0)), "real")
        col = F.col(t.columns[column])
        if e.name == "fts_match":
            return TX.matches(col, query), "bool"
        return search.bm25(col, query, search.corpus_stats(t.raw, column, query)), "real"

    def stored_score(self, t: Table, column: str, query: str) -> Column | None:
        """The score from stored postings, null without a hit; None where a scan has to tell."""
        if self.scored is None or t.stored is None or not TX.query_terms(query):
            return None
        if (column, query) not in self.scored:
            found = t.stored(column, query)
            if found is None:
                return None
            self.scored[column, query] = name = f"_f{len(self.scored)}"
            self.waiting.append((name, found))
        return F.col(self.scored[column, query])


# --- typed columns ------------------------------------------------------------


def literal(value: Any) -> Typed:
    match value:
        case None:
            return F.lit(None), "null"
        case bool():
            return F.lit(value), "bool"
        case int():
            return F.lit(value).cast("bigint"), "int"
        case float():
            return F.lit(value), "real"
        case str():
            return F.lit(value), "text"
        case list() | tuple():
            return F.array(*[F.lit(float(x)).cast("float") for x in value]).cast("array<float>"), "vector"
    raise GeneralError(f"a value of type {type(value).__name__} can't be used")


def shown(col: Column, kind: str) -> Column:
    return F.lit(None).cast("string") if kind == "null" else TX.display(col, kind)


def truth(col: Column, kind: str) -> Column:
    if kind == "bool":
        return col
    if kind == "null":
        return F.lit(None).cast("boolean")
    if kind == "int":
        return col != 0
    raise GeneralError("a condition must be a boolean or a whole number")


def compare(op: str, a: Typed, b: Typed) -> Column:
    """A comparison; unknown if a side is NULL; unlike types compare as their text."""
    if "null" in (a[1], b[1]):
        return F.lit(None).cast("boolean")
    left, right = a[0], b[0]
    if "node" in (a[1], b[1]) and {a[1], b[1]} & {"int", "real"}:  # what json_extract returns compares as the other side's type
        left, right = (c.try_cast("double") if k == "node" else c for c, k in (a, b))
    elif "node" in (a[1], b[1]) and "bool" in (a[1], b[1]):
        left, right = left.cast("string"), right.cast("string")
    elif not (a[1] == b[1] or {a[1], b[1]} <= {"int", "real"} or {a[1], b[1]} <= {"text", "json", "node"} or "other" in (a[1], b[1])):
        left, right = shown(*a), shown(*b)
    match op:
        case "=":
            return left == right
        case "<>":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
    return left >= right


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """Whole numbers stay whole, and divide towards zero; anything with a real is real."""
    if "null" in (a[1], b[1]):
        return F.lit(None).cast("double"), "real"
    for _, kind in (a, b):
        if kind not in (*NUMERIC, "bool", "node"):
            raise GeneralError(f"{op} needs numbers, not {kind}")
    whole = a[1] == b[1] == "int"
    x, y = (a[0], b[0]) if whole else (a[0].cast("double"), b[0].cast("double"))
    kind = "int" if whole else "real"
    match op:
        case "+":
            return x + y, kind
        case "-":
            return x - y, kind
        case "*":
            return x * y, kind
    by_zero = F.raise_error(F.lit("division by zero" if op == "/" else "modulo by zero")).cast("bigint" if whole else "double")
    if op == "/":
        value = F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))) if whole else x / F.nullif(y, F.lit(0.0))
    else:
        value = x % F.nullif(y, F.lit(0).cast("bigint") if whole else F.lit(0.0))
    return F.when(y == 0, by_zero).otherwise(value), kind


# --- SELECT -------------------------------------------------------------------


class Selection:
    """A SELECT over tables that a catalogue resolves; :meth:`frame` is the result."""

    def __init__(self, query: A.Select, resolve: Callable[[A.Source, int], Table], params: list[Any] | None = None):
        self.query, self.params = query, params
        seen: set[str] = set()
        for source in (query.source, *[j.source for j in query.joins]):
            if source.scope.lower() in seen:
                raise GeneralError(f"duplicate table reference '{source.scope}': use an alias")
            seen.add(source.scope.lower())
        self.binder = Binder([resolve(query.source, 0)], params)
        self.df = self.binder.tables[0].df
        if not query.joins and self.binder.tables[0].rowid:
            self.binder.scored = {}
        for i, join in enumerate(query.joins, 1):
            self.add_join(join, resolve(join.source, i))

    def add_join(self, join: A.Join, right: Table) -> None:
        left = list(self.binder.tables)
        names = join.using
        if join.natural:
            names = tuple(c for c in right.columns if any(c in t.columns for t in left))
        pairs = []
        for name in names:
            owner = next((i for i, t in enumerate(left) if name in t.columns), None)
            if owner is None or name not in right.columns:
                raise GeneralError(f"column '{name}' of USING isn't on both sides")
            pairs.append((owner, name))
        self.binder.tables.append(right)
        if pairs:
            last = len(self.binder.tables) - 1
            condition = reduce(lambda a, b: a & b, [compare("=", (F.col(left[o].columns[n]), left[o].kinds[n]), (F.col(right.columns[n]), right.kinds[n])) for o, n in pairs])
            self.df = self.df.join(right.df, condition, join.how)
            for owner, name in pairs:  # the shared column is shown once, with the value of the side that has one
                both = F.coalesce(F.col(left[owner].columns[name]), F.col(right.columns[name]))
                merged = f"{left[owner].columns[name]}_{last}"
                if join.how in ("right", "full"):
                    self.df = self.df.withColumn(merged, both)
                    left[owner].columns[name] = merged
                self.binder.hidden.add((last, name))
        elif join.on is not None:
            self.df = self.df.join(right.df, self.binder.truth(join.on), join.how)
        elif join.how == "inner":
            self.df = self.df.crossJoin(right.df)
        else:
            self.df = self.df.join(right.df, F.lit(True), join.how)

    def limit(self) -> int | None:
        found = self.query.limit
        if isinstance(found, A.Param):
            value = self.params[found.index] if self.params and found.index < len(self.params) else None
            if type(value) is not int or value < 0:
                raise GeneralError("LIMIT must be a non-negative integer")
            return value
        return None if found is None else found.value

    def frame(self) -> DataFrame:
        q = self.query
        if q.where is not None:
            condition = self.binder.truth(q.where)
            self.join_scores()
            self.df = self.df.filter(condition)
        if q.group or any(isinstance(i.expr, A.Aggregate) for i in q.items or ()):
            return self.grouped()
        headers, columns = self.projection()
        limit = self.limit()
        key = self.sort_key(q.order) if q.order is not None else None
        self.join_scores()
        keys = [f"_c{i}" for i in range(len(columns))]
        df = self.df
        rowid = self.binder.tables[0].rowid
        ties = [F.col(t.rowid).asc_nulls_first() for t in self.binder.tables if t.rowid]
        if q.distinct:
            if q.order is None:
                df = df.select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)]).distinct()
            else:
                df = df.select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)], key.alias("_key"))
                nulls = F.max(F.col("_key").isNull())
                first = F.max("_key") if q.descending else F.when(nulls, F.lit(None)).otherwise(F.min("_key"))
                df = df.groupBy(*keys).agg(first.alias("_key"))
                df = df.orderBy(F.col("_key").desc_nulls_last() if q.descending else F.col("_key").asc_nulls_first(), *keys)
        else:
            if q.order is not None:
                if any(t.rowid is None for t in self.binder.tables):  # nothing but what is shown tells rows apart
                    kinds = df.select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)]).schema
                    ties += [c.asc_nulls_first() for c, field in zip(columns, kinds, strict=True) if sortable(field.dataType)]
                df = df.orderBy(key.desc_nulls_last() if q.descending else key.asc_nulls_first(), *ties)
            elif rowid and limit is not None:
                df = df.orderBy(*ties)
            df = df.select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)]) if limit is None else df.limit(limit).select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)])
        if q.distinct and limit is not None:
            df = df.limit(limit)
        return df.select(*keys).toDF(*headers)

    def join_scores(self) -> None:
        """Join the scores that the expressions lowered so far speak of, by row id; a filter on a hit makes it an inner join."""
        while self.binder.waiting:
            name, found = self.binder.waiting.pop()
            told = found.select(F.col("id").alias(f"{name}_id"), F.col("score").alias(name))
            self.df = self.df.join(told, F.col(self.binder.tables[0].rowid) == F.col(f"{name}_id"), "left")

    def sort_key(self, e: Any) -> Column:
        """ORDER BY takes an expression over the tables, or an alias of the projection."""
        if isinstance(e, A.Name) and e.qualifier is None and not any(e.column in t.columns for t in self.binder.tables):
            for item in self.query.items or ():
                if item.alias == e.column:
                    return self.binder.lower(item.expr)[0]
        return self.binder.lower(e)[0]

    def projection(self) -> tuple[list[str], list[Column]]:
        if self.query.items is not None:
            return [i.header for i in self.query.items], [self.binder.column(i.expr)[0] for i in self.query.items]
        headers, columns = [], []
        for i, t in enumerate(self.binder.tables):
            for name, internal in t.columns.items():
                if (i, name) not in self.binder.hidden:
                    headers.append(name)
                    columns.append(F.col(internal))
        return headers, columns

    # --- grouping ---------------------------------------------------------

    def aggregate(self, e: A.Aggregate) -> Typed:
        if e.arg is None:
            return F.count(F.lit(1)), "int"
        col, kind = self.binder.column(e.arg)
        match e.name:
            case "COUNT":
                return (F.count_distinct(col) if e.distinct else F.count(col)), "int"
            case "SUM" | "AVG":
                if kind not in (*NUMERIC, "bool"):
                    raise GeneralError(f"{e.display} needs numbers")
                col = col.cast("bigint") if kind == "bool" else col
                if e.name == "AVG":
                    return F.avg(col), "real"
                return F.sum(col), "int" if kind == "bool" else kind
            case "MIN" | "MAX" if kind == "vector":  # vectors compare as their text
                return (F.min_by if e.name == "MIN" else F.max_by)(col, shown(col, kind)), kind
            case "MIN":
                return F.min(col), kind
        return F.max(col), kind

    def grouped(self) -> DataFrame:
        q = self.query
        keys = [self.binder.find(k) for k in q.group]
        key_names = [self.binder.tables[i].columns[c] for i, c in keys]
        slots: dict[str, Typed] = {}
        kinds: dict[str, str] = {}

        def slot(e: A.Aggregate) -> str:
            name = "_a_count_all" if e.arg is None else f"_a_{e.name}_{e.distinct}_{self.binder.tables[self.binder.find(e.arg)[0]].columns[e.arg.column]}"
            if name not in slots:
                slots[name] = self.aggregate(e)
                kinds[name] = slots[name][1]
            return name

        outputs: list[tuple[str, str]] = []  # header, internal name
        for item in q.items or ():
            if isinstance(item.expr, A.Aggregate):
                outputs.append((item.header, slot(item.expr)))
            else:
                if self.binder.find(item.expr) not in keys:
                    raise GeneralError(f"column '{item.expr.column}' must be in GROUP BY or in an aggregate")
                i, c = self.binder.find(item.expr)
                outputs.append((item.header, self.binder.tables[i].columns[c]))
        after = _Grouped(self, keys, slot, kinds, dict(zip([i.alias for i in q.items or ()], [n for _, n in outputs], strict=True)))
        having = after.truth(q.having) if q.having is not None else None
        order = after.order(q.order) if q.order is not None else None
        aggregates = [c.alias(n) for n, (c, _) in slots.items()]
        df = self.df.groupBy(*key_names).agg(*aggregates) if aggregates else self.df.select(*key_names).distinct()
        if having is not None:
            df = df.filter(having)
        names = [n for _, n in outputs]
        if q.distinct:
            df = df.select(*[F.col(n).alias(f"_d{i}") for i, n in enumerate(names)], *([order.alias("_key")] if order is not None else []))
            shown_names = [f"_d{i}" for i in range(len(names))]
            if order is not None:
                df = df.groupBy(*shown_names).agg((F.max if q.descending else F.min)("_key").alias("_key"))
                order = F.col("_key")
            else:
                df = df.distinct()
            names = shown_names
        if order is not None:
            df = df.orderBy(order.desc_nulls_last() if q.descending else order.asc_nulls_first(), *dict.fromkeys(names))
        if (limit := self.limit()) is not None:
            df = df.limit(limit)
        return df.select(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(names)]).toDF(*[h for h, _ in outputs])


class _Grouped(Binder):
    """Names after grouping: keys, aliases of the projection, and aggregates, which are computed if need be."""

    def __init__(self, selection: Selection, keys: list[tuple[int, str]], slot: Callable, kinds: dict[str, str], aliases: dict):
        super().__init__(selection.binder.tables, selection.params)
        self.hidden = selection.binder.hidden
        self.selection, self.keys, self.slot, self.slot_kinds, self.aliases = selection, keys, slot, kinds, aliases

    def column(self, name: A.Name) -> Typed:
        if name.qualifier is None and name.column in self.aliases:
            internal = self.aliases[name.column]
            return F.col(f"`{internal}`"), self.slot_kinds.get(internal) or next(t.kinds[c] for t in self.tables for c, n in t.columns.items() if n == internal)
        found = self.find(name)
        if found not in self.keys:
            raise GeneralError(f"column '{name.column}' is neither a GROUP BY key nor an output column")
        t = self.tables[found[0]]
        return F.col(t.columns[found[1]]), t.kinds[found[1]]

    def lower(self, e: Any) -> Typed:
        if isinstance(e, A.Aggregate):
            name = self.slot(e)
            return F.col(f"`{name}`"), self.slot_kinds[name]
        return super().lower(e)

    def order(self, e: Any) -> Column:
        if not isinstance(e, A.Name | A.Aggregate):
            raise GeneralError("ORDER BY of a grouped query takes an output column or an aggregate")
        return self.lower(e)[0]
