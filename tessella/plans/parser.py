"""Recursive-descent parser of the strict SQL dialect.

What the dialect leaves out raises :class:`NotImplementedFeature` with the name of
the feature, so a statement is either carried out fully or rejected up front.
"""

from __future__ import annotations

from typing import Any

from tessella.errors import GeneralError, NotImplementedFeature, SqlError
from tessella.plans import ast as A
from tessella.plans.lexer import Token, tokens

#: Declared types and what they are stored as.
TYPES = {
    "TINYINT": "int", "SMALLINT": "int", "INT2": "int", "INT": "int", "INT4": "int", "INT8": "int", "INTEGER": "int", "BIGINT": "int",
    "BOOLEAN": "bool",
    "TEXT": "text", "VARCHAR": "text",
    "REAL": "real", "FLOAT": "real", "DOUBLE": "real", "DECIMAL": "real",
    "JSON": "json", "JSONB": "json",
    "VECTOR": "vector",
}

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}

#: Words that can't be a name or alias where one is optional.
RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AND OR NOT AS SET VALUES UNION INTERSECT EXCEPT "
    "IS NULL LIKE ILIKE IN BETWEEN CASE WHEN THEN ELSE END EXISTS DISTINCT BY ASC DESC WITH WINDOW GLOB REGEXP ESCAPE OUTER SEMI ANTI LATERAL".split()
)


class Parser:
    def __init__(self, sql: str):
        self.tokens: list[Token] = tokens(sql)
        self.at = 0
        self.params = 0

    # --- reading tokens -------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def word(self, *words: str) -> bool:
        """Take the keywords if they come next."""
        if all(self.ahead(i).word == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise SqlError(f"expected {' '.join(words)}, found {self.now.text or 'end of statement'!r}")

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise SqlError(f"expected {text!r}, found {self.now.text or 'end of statement'!r}")

    def name(self) -> str:
        token = self.now
        if token.kind == "quoted" or token.kind == "name" and token.word not in RESERVED:
            return self.take().text
        raise SqlError(f"expected a name, found {token.text or 'end of statement'!r}")

    def names(self) -> tuple[str, ...]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return tuple(out)

    def reject(self, condition: bool, what: str) -> None:
        if condition:
            raise NotImplementedFeature(f"{what} is not supported")

    # --- statements -----------------------------------------------------

    def statement(self) -> Any:
        """The one statement of the text; None if there is none."""
        while self.op(";"):
            pass
        if self.now.kind == "end":
            return None
        found = self._statement()
        more = 1
        while self.op(";"):
            if self.now.kind != "end" and not (self.now.kind == "op" and self.now.text == ";"):
                more += 1
                while self.now.kind != "end" and not (self.now.kind == "op" and self.now.text == ";"):
                    self.take()
        if more > 1:
            raise SqlError(f"Expected a single query statement, but there are {more}")
        if self.now.kind != "end":
            raise SqlError(f"unexpected {self.now.text!r} after the statement")
        return found

    def _statement(self) -> Any:
        if self.word("SELECT"):
            return self.select()
        if self.word("INSERT"):
            return self.insert()
        if self.word("UPDATE"):
            return self.update()
        if self.word("DELETE"):
            return self.delete()
        if self.word("CREATE"):
            return self.create()
        if self.word("DROP"):
            return self.drop()
        if self.word("ALTER"):
            return self.alter()
        if self.word("PRAGMA"):
            return self.pragma()
        if self.word("VACUUM"):
            self.reject(self.now.kind != "end" and self.now.text != ";", "VACUUM with modifiers (FULL, REINDEX, table targets)")
            return A.Plain("vacuum")
        if self.word("BEGIN", "CONCURRENT"):
            self.word("TRANSACTION")
            return A.Plain("begin concurrent")
        if self.word("BEGIN") or self.word("START", "TRANSACTION"):
            self.reject(self.now.word in ("IMMEDIATE", "EXCLUSIVE", "DEFERRED"), f"BEGIN {self.now.word}")
            self.word("TRANSACTION")
            return A.Plain("begin")
        if self.word("COMMIT"):
            self.word("TRANSACTION")
            return A.Plain("commit")
        if self.word("ROLLBACK"):
            self.word("TRANSACTION")
            self.reject(self.now.word == "TO", "ROLLBACK TO SAVEPOINT")
            return A.Plain("rollback")
        for what in ("WITH", "VALUES", "SAVEPOINT", "RELEASE", "ATTACH", "DETACH", "REPLACE", "EXPLAIN", "MERGE", "TRUNCATE"):
            self.reject(self.now.word == what, what)
        raise SqlError(f"unknown statement {self.now.text!r}")

    def source(self) -> A.Source:
        self.reject(self.now.kind == "op" and self.now.text == "(", "a subquery in FROM")
        self.reject(self.now.word == "LATERAL", "LATERAL")
        table = self.name()
        self.reject(self.now.kind == "op" and self.now.text == ".", "a schema-qualified table name")
        self.reject(self.now.kind == "op" and self.now.text == "(", "a table function")
        if self.word("AS"):
            return A.Source(table, self.name())
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
            return A.Source(table, self.take().text)
        return A.Source(table)

    def select(self) -> A.Select:
        distinct = self.word("DISTINCT")
        self.reject(distinct and self.now.word == "ON", "DISTINCT ON")
        self.reject(self.now.word == "ALL", "SELECT ALL")
        items = None
        if self.op("*"):
            self.reject(self.now.kind == "op" and self.now.text == ",", "* beside other items")
        else:
            items = [self.item()]
            while self.op(","):
                items.append(self.item())
        self.reject(self.now.word != "FROM" and (self.now.kind == "end" or self.now.text == ";"), "SELECT without FROM")
        self.need("FROM")
        source, joins = self.source(), []
        self.reject(self.now.kind == "op" and self.now.text == ",", "a comma-separated FROM list (use an explicit JOIN)")
        while join := self.join():
            joins.append(join)
            self.reject(self.now.kind == "op" and self.now.text == ",", "a comma-separated FROM list (use an explicit JOIN)")
        where = self.expr() if self.word("WHERE") else None
        group: list[A.Name] = []
        if self.word("GROUP", "BY"):
            for what in ("ALL", "ROLLUP", "CUBE", "GROUPING"):
                self.reject(self.now.word == what, f"GROUP BY {what}")
            group = [self.group_key()]
            while self.op(","):
                group.append(self.group_key())
        having = None
        if self.word("HAVING"):
            self.reject(not group, "HAVING without GROUP BY")
            having = self.expr()
        self.reject(self.now.word == "WINDOW", "WINDOW")
        order, descending = None, False
        if self.word("ORDER", "BY"):
            self.reject(self.now.word == "ALL", "ORDER BY ALL")
            order = self.expr()
            descending = self.word("DESC")
            if not descending:
                self.word("ASC")
            self.reject(self.now.word == "NULLS", "NULLS FIRST/LAST")
            self.reject(self.now.kind == "op" and self.now.text == ",", "ORDER BY with several keys")
        limit = None
        if self.word("LIMIT"):
            limit = self.primary()
            if not isinstance(limit, A.Param) and not (isinstance(limit, A.Literal) and type(limit.value) is int and limit.value >= 0):
                raise GeneralError("LIMIT must be a non-negative integer")
        self.reject(self.now.word in ("OFFSET", "FETCH"), self.now.word)
        self.reject(self.now.word in ("UNION", "INTERSECT", "EXCEPT"), self.now.word)
        aggregating = bool(group) or any(isinstance(i.expr, A.Aggregate) for i in items or ())
        if aggregating and items is None:
            raise GeneralError("SELECT * can't be grouped: name the columns")
        return A.Select(tuple(items) if items is not None else None, source, tuple(joins), where, tuple(group), having, order, descending, limit, distinct)

    def item(self) -> A.Item:
        expr = self.expr()
        self.reject(self.now.kind == "op" and self.now.text == "*", "a qualified *")
        if isinstance(expr, A.Name | A.Aggregate):
            if self.word("AS"):
                return A.Item(expr, self.name())
            if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in RESERVED:
                return A.Item(expr, self.take().text)
            return A.Item(expr)
        raise NotImplementedFeature("an expression in the projection is not supported: only columns and aggregates are")

    def group_key(self) -> A.Name:
        key = self.expr()
        self.reject(not isinstance(key, A.Name), "GROUP BY on an expression")
        return key

    def join(self) -> A.Join | None:
        natural, cross, how = self.word("NATURAL"), False, "inner"
        if self.word("CROSS"):
            cross = True
        elif self.word("INNER"):
            pass
        else:
            for word in ("LEFT", "RIGHT", "FULL"):
                if self.word(word):
                    how = word.lower()
                    self.reject(self.now.word in ("SEMI", "ANTI"), f"{self.now.word} JOIN")
                    self.word("OUTER")
                    break
            else:
                for what in ("SEMI", "ANTI", "ASOF"):
                    self.reject(self.now.word == what, f"{what} JOIN")
                if not natural and self.now.word != "JOIN":
                    return None
        self.need("JOIN")
        source = self.source()
        on, using = None, ()
        if self.word("ON"):
            on = self.expr()
        elif self.word("USING"):
            using = self.names()
        if natural and (on is not None or using):
            raise SqlError("NATURAL JOIN takes no ON or USING")
        self.reject(on is None and not using and not natural and not cross, "JOIN without a condition")
        return A.Join(source, how, on, using, natural, cross)

    def insert(self) -> A.Insert:
        self.reject(self.now.word == "OR", "INSERT OR ...")
        self.need("INTO")
        table = self.name()
        if not (self.now.kind == "op" and self.now.text == "("):
            self.reject(self.now.word == "SELECT", "INSERT ... SELECT")
            raise NotImplementedFeature("INSERT needs a column list")
        columns = self.names()
        self.reject(self.now.word == "SELECT", "INSERT ... SELECT")
        self.need("VALUES")
        rows = []
        while True:
            self.need_op("(")
            row = [self.expr()]
            while self.op(","):
                row.append(self.expr())
            self.need_op(")")
            rows.append(tuple(row))
            if not self.op(","):
                break
        self.reject(self.now.word in ("ON", "RETURNING"), f"INSERT ... {self.now.word}")
        return A.Insert(table, columns, tuple(rows))

    def update(self) -> A.Update:
        self.reject(self.now.word == "OR", "UPDATE OR ...")
        source = self.source()
        self.reject(self.now.word in ("JOIN", "INNER", "LEFT"), "UPDATE with a join")
        self.need("SET")
        sets = []
        while True:
            self.reject(self.now.kind == "op" and self.now.text == "(", "a tuple of UPDATE targets")
            column = self.name()
            if self.op("."):
                if column.lower() != source.scope.lower():
                    raise GeneralError(f"unknown table qualifier '{column}'")
                column = self.name()
            self.need_op("=")
            sets.append((column, self.expr()))
            if not self.op(","):
                break
        self.reject(self.now.word in ("FROM", "RETURNING", "ORDER", "LIMIT") and True, f"UPDATE ... {self.now.word}")
        return A.Update(source, tuple(sets), self.expr() if self.word("WHERE") else None)

    def delete(self) -> A.Delete:
        self.need("FROM")
        source = self.source()
        self.reject(self.now.kind == "op" and self.now.text == "," or self.now.word in ("USING", "JOIN"), "DELETE from several tables")
        where = self.expr() if self.word("WHERE") else None
        self.reject(self.now.word in ("RETURNING", "ORDER", "LIMIT"), f"DELETE ... {self.now.word}")
        return A.Delete(source, where)

    def column_def(self) -> A.ColumnDef:
        name = self.name()
        declared = self.take().text if self.now.kind == "name" else ""
        self.word("PRECISION")
        kind = TYPES.get(declared.upper())
        if kind is None:
            raise GeneralError(f"column '{name}' has an unknown type {declared!r}")
        dim = 0
        if self.op("("):
            size = [self.take()]
            while self.op(","):
                size.append(self.take())
            self.need_op(")")
            if any(t.kind != "number" for t in size):
                raise SqlError(f"bad size of the type of column '{name}'")
            if kind == "vector":
                dim = int(size[0].text) if size[0].text.isdigit() else 0
        if kind == "vector" and dim < 1:
            raise GeneralError(f"column '{name}': VECTOR needs a dimension of 1 or more")
        flags: dict[str, Any] = {}
        while True:
            if self.word("PRIMARY", "KEY"):
                flags |= {"primary_key": True, "unique": True, "not_null": True}
                self.reject(self.now.word == "AUTOINCREMENT", "AUTOINCREMENT")
            elif self.word("UNIQUE"):
                flags["unique"] = True
            elif self.word("NOT", "NULL"):
                flags["not_null"] = True
            elif self.word("NULL"):
                pass
            elif self.word("DEFAULT"):
                value = self.unary()
                if isinstance(value, A.Unary) and value.op in "+-" and isinstance(value.operand, A.Literal) and type(value.operand.value) in (int, float):
                    value = A.Literal(-value.operand.value if value.op == "-" else value.operand.value)
                if not isinstance(value, A.Literal):
                    raise NotImplementedFeature(f"DEFAULT of column '{name}' must be a literal")
                flags |= {"default": value.value, "has_default": True}
            elif self.now.word in ("CHECK", "REFERENCES"):  # accepted and not enforced
                self.take()
                self.skip_parens_after_names()
            else:
                return A.ColumnDef(name, kind, declared.upper(), dim, **flags)

    def skip_parens_after_names(self) -> None:
        while self.now.kind in ("name", "quoted") and self.now.word not in ("NOT", "UNIQUE", "PRIMARY", "DEFAULT"):
            self.take()
        if self.op("("):
            depth = 1
            while depth and self.now.kind != "end":
                text = self.take().text
                depth += (text == "(") - (text == ")")

    def create(self) -> Any:
        unique = self.word("UNIQUE")
        if self.word("INDEX"):
            return self.create_index(unique)
        for what in ("VIEW", "TRIGGER", "VIRTUAL", "TEMP", "TEMPORARY", "SCHEMA", "DATABASE"):
            self.reject(self.now.word == what, f"CREATE {what}")
        self.need("TABLE")
        guard = self.word("IF", "NOT", "EXISTS")
        table = self.name()
        self.reject(self.now.word == "AS", "CREATE TABLE ... AS")
        self.need_op("(")
        columns = []
        while True:
            if self.now.word in ("PRIMARY", "FOREIGN", "CHECK", "CONSTRAINT") or self.now.word == "UNIQUE" and self.ahead().text == "(":
                while not (self.now.kind == "op" and self.now.text in ",)") and self.now.kind != "end":  # table constraints are accepted and not enforced
                    if self.op("("):
                        depth = 1
                        while depth and self.now.kind != "end":
                            text = self.take().text
                            depth += (text == "(") - (text == ")")
                    else:
                        self.take()
            else:
                columns.append(self.column_def())
            if not self.op(","):
                break
        self.need_op(")")
        if not columns:
            raise GeneralError("a table needs a column")
        return A.CreateTable(table, tuple(columns), guard)

    def create_index(self, unique: bool) -> A.CreateIndex:
        guard = self.word("IF", "NOT", "EXISTS")
        self.reject(self.now.word == "ON", "an anonymous index")
        name = self.name()
        self.need("ON")
        table = self.name()
        using = self.name().lower() if self.word("USING") else "btree"
        columns = self.names()
        self.reject(len(columns) > 1, "an index on several columns")
        metric = "l2"
        if self.word("WITH"):
            self.need_op("(")
            if self.name().lower() != "metric":
                raise GeneralError("the only option of an index is metric")
            self.need_op("=")
            given = self.take().text.lower()
            metric = {"l2": "l2", "euclidean": "l2", "cosine": "cosine", "dot": "dot", "inner_product": "dot", "ip": "dot"}.get(given, "")
            if not metric:
                raise GeneralError(f"unknown metric {given!r}")
            self.need_op(")")
            if using != "hnsw":
                raise GeneralError("metric is an option of hnsw indexes only")
        self.reject(self.now.word == "WHERE", "a partial index")
        if using not in ("btree", "hnsw", "fts"):
            raise NotImplementedFeature(f"index method '{using}' is not supported")
        return A.CreateIndex(name, table, columns[0], unique, using, metric, guard)

    def drop(self) -> A.Drop:
        for what in ("VIEW", "TRIGGER", "SCHEMA"):
            self.reject(self.now.word == what, f"DROP {what}")
        kind = "table" if self.word("TABLE") else "index"
        if kind == "index":
            self.need("INDEX")
        guard = self.word("IF", "EXISTS")
        name = self.name()
        self.reject(self.now.kind == "op" and self.now.text == ",", "DROP with several targets")
        return A.Drop(kind, name, guard)

    def alter(self) -> A.Alter:
        self.need("TABLE")
        guard = self.word("IF", "EXISTS")
        table = self.name()
        if self.word("RENAME", "TO"):
            found = A.Alter(table, "rename", new=self.name(), if_exists=guard)
        elif self.word("RENAME"):
            self.word("COLUMN")
            old = self.name()
            self.need("TO")
            found = A.Alter(table, "rename_column", old, self.name(), if_exists=guard)
        elif self.word("ADD"):
            self.word("COLUMN")
            missing = self.word("IF", "NOT", "EXISTS")
            found = A.Alter(table, "add_column", column=self.column_def(), if_exists=guard, column_guard=missing)
        elif self.word("DROP"):
            self.word("COLUMN")
            there = self.word("IF", "EXISTS")
            found = A.Alter(table, "drop_column", self.name(), if_exists=guard, column_guard=there)
            self.word("CASCADE") or self.word("RESTRICT")
        else:
            raise NotImplementedFeature(f"ALTER TABLE ... {self.now.text} is not supported")
        self.reject(self.now.kind == "op" and self.now.text == ",", "ALTER TABLE with several operations")
        return found

    def pragma(self) -> A.Pragma:
        name = self.name().lower()
        value = None
        if self.op("="):
            value = self.pragma_value()
        elif self.op("("):
            value = self.pragma_value()
            self.need_op(")")
        return A.Pragma(name, value)

    def pragma_value(self) -> Any:
        sign = -1 if self.op("-") else 1
        token = self.take()
        if token.kind == "number":
            return sign * float(token.text)
        if token.kind in ("name", "string", "quoted"):
            return token.text
        raise SqlError("a PRAGMA takes one value")

    # --- expressions ----------------------------------------------------

    def expr(self) -> Any:
        left = self.conjunction()
        while self.word("OR"):
            left = A.Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.negation()
        while self.word("AND"):
            left = A.Binary("AND", left, self.negation())
        return left

    def negation(self) -> Any:
        if self.word("NOT"):
            self.reject(self.now.word == "EXISTS", "EXISTS")
            return A.Unary("NOT", self.negation())
        return self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        while True:
            if self.now.kind == "op" and self.now.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.take().text
                left = A.Binary("<>" if op == "!=" else op, left, self.sum())
            elif self.word("IS"):
                negated = self.word("NOT")
                self.need("NULL")
                left = A.IsNull(left, negated)
            else:
                negated = self.now.word == "NOT" and self.ahead().word in ("LIKE", "ILIKE", "IN", "BETWEEN", "GLOB", "REGEXP")
                if negated:
                    self.take()
                for what in ("BETWEEN", "GLOB", "REGEXP", "SIMILAR", "RLIKE"):
                    self.reject(self.now.word == what, what)
                if self.word("LIKE") or self.word("ILIKE"):
                    self.reject(self.now.word == "ANY", "LIKE ANY")
                    left = A.Like(left, self.sum(), negated)
                    self.reject(self.now.word == "ESCAPE", "LIKE ... ESCAPE")
                elif self.word("IN"):
                    self.reject(self.now.word == "UNNEST", "IN UNNEST")
                    self.need_op("(")
                    self.reject(self.now.word in ("SELECT", "WITH"), "IN (subquery)")
                    items = [self.expr()]
                    while self.op(","):
                        items.append(self.expr())
                    self.need_op(")")
                    left = A.InList(left, tuple(items), negated)
                else:
                    return left

    def sum(self) -> Any:
        left = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            op = self.take().text
            left = A.Binary(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.take().text
            left = A.Binary(op, left, self.unary())
        return left

    def unary(self) -> Any:
        for sign in "+-":
            if self.op(sign):
                return A.Unary(sign, self.unary())
        return self.primary()

    def primary(self) -> Any:
        token = self.now
        if token.kind == "number":
            self.take()
            whole = token.text.isdigit() and int(token.text) < 1 << 63
            return A.Literal(int(token.text) if whole else float(token.text))
        if token.kind == "string":
            return A.Literal(self.take().text)
        if token.kind == "vector":
            self.take()
            inner = token.text[1:-1].strip()
            try:
                return A.Literal(tuple(float(x) for x in inner.split(",")) if inner else ())
            except ValueError:
                raise SqlError(f"bad vector literal {token.text}") from None
        if token.kind == "param":
            self.take()
            index = int(token.text[1:]) - 1 if len(token.text) > 1 else self.params
            if index < 0:
                raise SqlError("parameters are numbered from 1")
            self.params = max(self.params, index + 1)
            return A.Param(index)
        if self.op("("):
            self.reject(self.now.word in ("SELECT", "WITH"), "a subquery")
            inner = self.expr()
            self.need_op(")")
            return inner
        self.reject(token.kind == "op" and token.text in ":$@", "a named parameter")
        for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.word(word):
                return A.Literal(value)
        for what in ("CASE", "CAST", "EXISTS"):
            self.reject(token.word == what and (what == "CASE" or self.ahead().text == "("), what)
        name = self.name()
        if self.op("("):
            return self.call(name)
        if self.op("."):
            self.reject(self.now.kind == "op" and self.now.text == "*", "a qualified *")
            return A.Name(self.name(), name)
        return A.Name(name)

    def call(self, name: str) -> Any:
        if name.upper() not in AGGREGATES:
            args = []
            if not self.op(")"):
                args = [self.expr()]
                while self.op(","):
                    args.append(self.expr())
                self.need_op(")")
            self.reject(self.now.word == "OVER", "a window function")
            return A.Call(name.lower(), tuple(args))
        name = name.upper()
        distinct, arg = self.word("DISTINCT"), None
        self.reject(distinct and name != "COUNT", f"DISTINCT in {name}")
        if self.op("*"):
            self.reject(name != "COUNT" or distinct, f"{name}({'DISTINCT ' if distinct else ''}*)")
        else:
            arg = self.expr()
            self.reject(not isinstance(arg, A.Name), f"{name} of an expression")
            self.reject(self.now.kind == "op" and self.now.text == ",", f"{name} with several arguments")
        self.need_op(")")
        for what in ("FILTER", "OVER", "WITHIN"):
            self.reject(self.now.word == what, f"{what} on an aggregate")
        return A.Aggregate(name, arg, distinct)


def parse(sql: str) -> A.Parsed:
    """The statement of a text (None for an empty one) and the number of its parameters."""
    parser = Parser(sql)
    statement = parser.statement()
    return A.Parsed(statement, parser.params)
