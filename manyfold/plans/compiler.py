"""Syntax tree to DataFrames: names and types are checked here, the plan is left to Catalyst."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import document, graph, relational, text, vector
from .ast import Agg, Call, Case, Col, Lit, Named, Path, QueryError, Select, SetOp, Sub, Var, Window, With

NUMERIC = ("int", "float")


@dataclass
class Options:
    """implicit_limit: rows of a SELECT without LIMIT (None: all). nan_less: NaN compares as less than anything, both
    ways; off, filters on doubles reach the scan as they are."""

    implicit_limit: int | None = 1000
    nan_less: bool = True
    recursion_limit: int = 1000
    max_rows: int | None = None


@dataclass
class Table:
    """A DataFrame and what parts of it mean: key (row id), doc (JSON text), vector (array), metric."""

    df: DataFrame
    key: str | None = None
    doc: str | None = None
    vector: str | None = None
    metric: str = "l2"

    @property
    def hidden(self) -> set[str]:
        return {c for c in (self.doc, self.vector) if c}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.IntegralType,)):
        return "int"
    if isinstance(t, T.FractionalType):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.NullType):
        return "null"
    return t.simpleString()


class Scope:
    """Names of a DataFrame's columns, their kinds, and the tables, variables and options of a statement."""

    def __init__(self, compiler: Compiler, df: DataFrame, table: Table | None = None, doc: str | None = None) -> None:
        self.compiler, self.df, self.table = compiler, df, table
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        self.doc = doc or (table.doc if table else None)

    def column(self, name: str) -> str:
        if name in self.kinds:
            return name
        found = [c for c in self.kinds if c.split(".")[-1] == name] if "." not in name else [c for c in self.kinds if c == name.split(".", 1)[1] and not any("." in k for k in self.kinds)]
        if len(found) == 1:
            return found[0]
        raise QueryError(f"{'ambiguous' if found else 'unknown'} column {name!r}")

    def expr(self, e: Any) -> tuple[Column, str]:
        """A column and its kind."""
        if isinstance(e, Lit):
            v = e.value
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
            return (F.lit(v).cast("long") if kind == "int" else F.lit(v)), kind
        if isinstance(e, Var):
            if e.name not in self.compiler.vars:
                raise QueryError(f"no variable ${e.name}")
            return self.expr(Lit(self.compiler.vars[e.name]))
        if isinstance(e, Col):
            name = self.column(e.name)
            return F.col(f"`{name}`"), self.kinds[name]
        if isinstance(e, Case):
            values = [self.expr(v) for _, v in e.branches] + [self.expr(e.other if e.other is not None else Lit(None))]
            kind = self.common([k for _, k in values])
            out = F
            for (c, _), (v, _) in zip(e.branches, values):
                out = out.when(self.condition(c), self.cast(v, kind))
            return out.otherwise(self.cast(values[-1][0], kind)), kind
        if isinstance(e, Sub):
            return self.subquery(e)
        if isinstance(e, Call):
            return self.call(e)
        raise QueryError(f"{type(e).__name__} isn't an expression here")

    def cast(self, c: Column, kind: str) -> Column:
        return c.cast({"int": "long", "float": "double", "bool": "boolean", "text": "string"}[kind]) if kind in ("int", "float", "bool", "text") else c

    def common(self, kinds: list[str]) -> str:
        real = {k for k in kinds if k != "null"}
        if len(real) <= 1:
            return next(iter(real), "null")
        if real <= set(NUMERIC):
            return "float"
        raise QueryError(f"values of kinds {', '.join(sorted(real))} don't go together")

    def condition(self, e: Any) -> Column:
        c, kind = self.expr(e)
        if kind not in ("bool", "null"):
            raise QueryError(f"a condition is needed, not a value of kind {kind}")
        return c.cast("boolean") if kind == "null" else c

    def compare(self, op: str, a: Column, b: Column, kinds: list[str]) -> Column:
        kind = self.common(kinds)
        out = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if self.compiler.options.nan_less and kind == "float" and "float" in kinds:
            nan = F.lit(False)
            for c, k in zip((a, b), kinds):
                if k == "float":
                    nan = nan | F.isnan(c)
            known = a.isNotNull() & b.isNotNull()
            out = F.when(known & nan, F.lit(op in ("!=", "<", "<="))).otherwise(out)
        return out

    def pair(self, a: Any, b: Any) -> tuple[Column, Column, list[str]]:
        """Two operands; a document's scalar takes the kind of what it meets."""
        if isinstance(a, Call) and a.op == "get":
            if isinstance(b, Call) and b.op == "get":
                return self.get(a, "text"), self.get(b, "text"), ["text", "text"]
            y, k = self.expr(b)
            k2 = "float" if k in NUMERIC else "text" if k == "null" else k
            return self.get(a, k2), y, [k2, k]
        if isinstance(b, Call) and b.op == "get":
            y, x, kinds = self.pair(b, a)
            return x, y, kinds[::-1]
        (x, i), (y, j) = self.expr(a), self.expr(b)
        return x, y, [i, j]

    def get(self, e: Call, kind: str) -> Column:
        column, path = e.args
        doc = F.col(f"`{self.doc}`") if self.doc else self.expr(column)[0]
        return document.lookup(doc, path.value, kind)

    def call(self, e: Call) -> tuple[Column, str]:
        op, args = e.op, e.args
        if op in ("and", "or"):
            a, b = self.condition(args[0]), self.condition(args[1])
            return (a & b if op == "and" else a | b), "bool"
        if op == "not":
            return ~self.condition(args[0]), "bool"
        if op in ("=", "!=", "<", "<=", ">", ">="):
            a, b, kinds = self.pair(*args)
            return self.compare(op, a, b, kinds), "bool"
        if op in ("isnull", "isnotnull"):
            c = self.get(args[0], "text") if isinstance(args[0], Call) and args[0].op == "get" else self.expr(args[0])[0]
            return (c.isNull() if op == "isnull" else c.isNotNull()), "bool"
        if op == "in":
            if not args[1]:
                a = self.expr(args[0])[0]
                return F.when(a.isNotNull(), F.lit(False)), "bool"
            a = self.expr(args[0])
            items = [self.expr(x) for x in args[1]]
            self.common([a[1], *[k for _, k in items]])
            if self.compiler.options.nan_less and a[1] == "float":
                out = F.lit(False)
                for c, k in items:
                    out = out | self.compare("=", a[0], c, [a[1], k])
                return out, "bool"
            return a[0].isin(*[c for c, _ in items]), "bool"
        if op == "between":
            return self.call(Call("and", (Call(">=", args[:2]), Call("<=", (args[0], args[2])))))
        if op in ("like", "ilike"):
            (a, i), (b, j) = self.expr(args[0]), self.expr(args[1])
            if {i, j} - {"text", "null"}:
                raise QueryError("LIKE compares texts")
            if isinstance(args[1], Lit) and args[1].value is not None:
                pattern = args[1].value.replace("\\", "\\\\")
                return (a.like(pattern) if op == "like" else a.ilike(pattern)), "bool"
            pattern = F.replace(b, F.lit("\\"), F.lit("\\\\"))
            return (F.like(a, pattern) if op == "like" else F.ilike(a, pattern)), "bool"
        if op == "coalesce":
            values = [self.expr(x) for x in args]
            kind = self.common([k for _, k in values])
            return F.coalesce(*[self.cast(c, kind) for c, _ in values]), kind
        if op == "nullif":
            a, b, kinds = self.pair(*args)
            return F.when(~F.coalesce(self.compare("=", a, b, kinds), F.lit(False)), a), kinds[0]
        if op in ("+", "-", "*", "/"):
            (a, i), (b, j) = self.expr(args[0]), self.expr(args[1])
            if not {i, j} <= {*NUMERIC, "null"}:
                raise QueryError(f"{op!r} takes numbers")
            kind = self.common([i, j])
            if op == "/":
                whole = F.call_function("div", a, b) if kind == "int" else None
                return (whole if whole is not None else a / b), kind
            return {"+": a + b, "-": a - b, "*": a * b}[op], kind
        if op == "get":
            return self.get(e, "text"), "text"
        if op == "has":
            return document.contains(F.col(f"`{self.doc}`") if self.doc else self.expr(args[0])[0], args[1].value), "bool"
        if op == "match":
            raise QueryError("MATCH stands alone or under AND")
        raise QueryError(f"no operator {op!r}")

    def subquery(self, e: Sub) -> tuple[Column, str]:
        inner = self.compiler.query(e.query)
        if e.kind == "exists":
            return F.lit(not inner.isEmpty()), "bool"
        if len(inner.columns) != 1:
            raise QueryError("a subquery has one column here")
        kind = kind_of(inner.schema.fields[0].dataType)
        if e.kind == "scalar":
            rows = inner.limit(2).collect()
            if len(rows) > 1:
                raise QueryError("a scalar subquery gave more than one row")
            value, _ = self.expr(Lit(rows[0][0] if rows else None))
            return self.cast(value, kind), kind
        raise QueryError("IN (SELECT ...) stands under AND, or under NOT there")


def conjuncts(e: Any) -> list:
    if isinstance(e, Call) and e.op == "and":
        return [*conjuncts(e.args[0]), *conjuncts(e.args[1])]
    return [] if e is None else [e]


def has_node(e: Any, test) -> bool:
    if test(e):
        return True
    if isinstance(e, Call):
        return any(has_node(a, test) for a in e.args)
    if isinstance(e, Case):
        return any(has_node(x, test) for pair in e.branches for x in pair) or has_node(e.other, test)
    if isinstance(e, tuple):
        return any(has_node(a, test) for a in e)
    return False


def name_of(e: Any) -> str:
    if isinstance(e, Col):
        return e.name
    if isinstance(e, Lit):
        return "null" if e.value is None else str(e.value)
    if isinstance(e, Case):
        return "case"
    return e.op if isinstance(e, Call) else "value"


class Compiler:
    def __init__(self, tables: dict[str, Table], variables: dict[str, Any], options: Options, edges: DataFrame | None = None) -> None:
        self.tables, self.vars, self.options, self.edges = dict(tables), variables, options, edges

    # -- queries

    def query(self, q: Any) -> DataFrame:
        if isinstance(q, SetOp):
            return relational.set_operation(q.op, q.all, self.query(q.left), self.query(q.right))
        if isinstance(q, With):
            return self.with_(q)
        if isinstance(q, Select):
            return self.select(q)
        raise QueryError("a query is needed here")

    def with_(self, q: With) -> DataFrame:
        before = dict(self.tables)
        try:
            for name, body in q.ctes:
                recursive = q.recursive and isinstance(body, SetOp) and body.op == "union" and uses(body.right, name)
                self.tables[name] = Table(self.recursion(name, body) if recursive else self.query(body))
            return self.query(q.body)
        finally:
            self.tables = before

    def recursion(self, name: str, body: SetOp) -> DataFrame:
        def step(delta: DataFrame) -> DataFrame:
            inner = Compiler({**self.tables, name: Table(delta)}, self.vars, replace(self.options, implicit_limit=None), self.edges)
            return inner.query(body.right)

        return relational.fixed_point(self.query(body.left), step, distinct=not body.all, most=self.options.recursion_limit)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"no table {name!r}")
        return self.tables[name]

    def select(self, q: Select) -> DataFrame:
        table: Table | None = None
        if isinstance(q.source, tuple):
            df = self.query(q.source[0])
        else:
            table = self.table(q.source)
            df = table.df
        if q.join:
            if q.knn or q.traverse:
                raise QueryError("KNN and TRAVERSE don't go with JOIN")
            df, table = self.join(q, table, df), None
        scope = Scope(self, df, table)
        key = table.key if table else None
        order: list[Column] = []
        tests = conjuncts(q.where)
        for t in tests:
            if isinstance(t, Call) and t.op == "match":
                continue
            df = self.filtered(df, scope, t)
        for t in tests:
            if isinstance(t, Call) and t.op == "match":
                df, order = self.matched(df, scope, table, t)
        if q.knn:
            df, order = self.knn(df, scope, table, q)
        if q.traverse:
            df, order = self.traversed(df, table, q)
        aggregates = [i for i in q.items if isinstance(i, Agg)]
        if aggregates or q.group:
            if q.join and False:
                raise QueryError("no aggregates over a join")
            out, names = self.aggregated(q, df, scope)
            order = []
        else:
            out, names = self.projected(q, df, scope, table, key)
        return self.finished(q, out, names, scope, order, key)

    def filtered(self, df: DataFrame, scope: Scope, test: Any) -> DataFrame:
        no, inner = False, test
        while isinstance(inner, Call) and inner.op == "not":
            no, inner = not no, inner.args[0]
        if isinstance(inner, Sub) and inner.kind == "in":
            of, kind = scope.expr(inner.of)
            sub = self.query(inner.query)
            if len(sub.columns) != 1:
                raise QueryError("IN takes a subquery of one column")
            scope.common([kind, kind_of(sub.schema.fields[0].dataType)])
            return relational.in_subquery(df, of, sub, no)
        return df.where(scope.condition(test))

    def matched(self, df: DataFrame, scope: Scope, table: Table | None, t: Call) -> tuple[DataFrame, list[Column]]:
        if table is None or not table.key:
            raise QueryError("MATCH needs a table with a key")
        column = scope.column(t.args[0].name)
        hits = text.bm25(table.df, column, t.args[1].value, table.key).withColumnRenamed("score", "_score")
        if "_score" in df.columns:
            df = df.drop("_score")
        return df.join(hits, table.key), [F.desc("_score"), F.col(table.key)]

    def knn(self, df: DataFrame, scope: Scope, table: Table | None, q: Select) -> tuple[DataFrame, list[Column]]:
        if table is None or not table.vector:
            raise QueryError("KNN needs a table with vectors")
        v = [float(x) for x in q.knn.vector]
        if q.knn.mode == "quantized" and table.metric == "l2" and table.key:
            out = vector.knn_quantized(df, table.vector, v, q.knn.k, table.key)
        else:
            out = vector.knn(df, table.vector, v, q.knn.k, table.metric, table.key)
        out = out.withColumnRenamed("distance", "_distance")
        return out, [F.col("_distance"), *([F.col(table.key)] if table.key else [])]

    def traversed(self, df: DataFrame, table: Table | None, q: Select) -> tuple[DataFrame, list[Column]]:
        if table is None or not table.key or self.edges is None:
            raise QueryError("TRAVERSE needs a table with a key, and edges")
        nodes = df.select(F.col(table.key).cast("string").alias("node")).distinct()
        found = graph.traverse(self.edges.select("src", "dst"), nodes, q.traverse[1]).withColumnRenamed("depth", "_depth")
        return df.join(found, F.col(table.key).cast("string") == F.col("node")).drop("node"), [F.col("_depth"), F.col(table.key)]

    def join(self, q: Select, left: Table | None, df: DataFrame) -> DataFrame:
        if left is None:
            raise QueryError("JOIN is between tables")
        right, j = self.table(q.join.table), q.join
        named = lambda t, name: t.df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in t.df.columns if c not in t.hidden])
        a, b = named(left, q.source), named(right, j.table)
        if j.kind == "cross":
            return a.crossJoin(b)
        sides = {q.source: None, j.table: None}
        for t, c in (j.left, j.right):
            if t not in sides:
                raise QueryError(f"{t!r} isn't a side of the join")
            sides[t] = f"{t}.{c}"
        if None in sides.values():
            raise QueryError("ON compares a column of each side")
        x, y = sides[q.source], sides[j.table]
        for d, c in ((a, x), (b, y)):
            if c not in d.columns:
                raise QueryError(f"unknown column {c!r}")
        return relational.equi_join(a, b, x, y, j.kind)

    # -- projection

    def aggregated(self, q: Select, df: DataFrame, scope: Scope) -> tuple[DataFrame, list[str]]:
        if not q.items:
            raise QueryError("* doesn't go with aggregates")
        group = [scope.column(c) for c in q.group]
        outs: dict[str, Column] = {}
        names: list[str] = []
        for item in q.items:
            if isinstance(item, Agg):
                name = item.alias or self.agg_name(item)
                if name in names:
                    raise QueryError(f"two columns are named {name!r}")
                outs[name] = self.agg(item, scope)
                names.append(name)
            elif isinstance(item, Named) and isinstance(item.expr, Col):
                c = scope.column(item.expr.name)
                if c not in group:
                    raise QueryError(f"{c!r} is neither grouped nor aggregated")
                names.append(c)
            else:
                raise QueryError("only grouped columns and aggregates go together")
        hidden = []
        for k, (agg, op, value) in enumerate(q.having):
            outs[f"_having{k}"] = self.agg(agg, scope)
            hidden.append((f"_having{k}", op, value))
        keys = [F.col(f"`{c}`") for c in group]
        out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in outs.items()]) if outs else df.select(*keys).distinct()
        if hidden:
            inner = Scope(self, out)
            for name, op, value in hidden:
                out = out.where(inner.condition(Call(op, (Col(name), value))))
        return out, names

    def agg_name(self, a: Agg) -> str:
        if a.arg is None:
            return "count"
        return f"{a.func}_{name_of(a.arg)}".replace(".", "_")

    def agg(self, a: Agg, scope: Scope) -> Column:
        if a.arg is None:
            return F.count(F.lit(1))
        c, kind = scope.expr(a.arg)
        if a.func in ("sum", "avg") and kind not in (*NUMERIC, "null"):
            raise QueryError(f"{a.func.upper()} takes numbers, not {kind}")
        return {"count": F.count, "sum": F.sum, "avg": lambda x: F.avg(x.cast("double")), "min": F.min, "max": F.max}[a.func](c)

    def projected(self, q: Select, df: DataFrame, scope: Scope, table: Table | None, key: str | None) -> tuple[DataFrame, list[str]]:
        if not q.items:
            hidden = table.hidden if table else set()
            return df, [c for c in df.columns if c not in hidden and not c.startswith("_")]
        names: list[str] = []
        new: dict[str, Column] = {}
        for item in q.items:
            if isinstance(item, Named) and isinstance(item.expr, Col) and not item.alias:
                name = scope.column(item.expr.name)
                if name not in names:
                    names.append(name)
                continue
            if isinstance(item, Named):
                name = item.alias or name_of(item.expr)
                new[name] = scope.expr(item.expr)[0]
            elif isinstance(item, Window):
                name = item.alias or f"{item.func}({item.arg or ''})"
                new[name] = relational.window_column(item, scope.kinds, scope.column, key)
            elif isinstance(item, Path):
                name = item.alias or "".join(("->" if h.out else "<-") + h.label + ("->" if h.out else "<-") + h.table for h in item.hops)
                if not key or self.edges is None:
                    raise QueryError("a path needs a table with a key, and edges")
                found = graph.paths(self.edges, df.select(F.col(key).cast("string").alias("start")), q.source, [(h.out, h.label, h.table) for h in item.hops], item.hops[-1].fields)
                df = df.join(found.select(F.col("start").alias("_start"), F.col("value").alias(f"_path{len(names)}")), F.col(key).cast("string") == F.col("_start"), "left").drop("_start")
                new[name] = F.col(f"_path{len(names)}")
            else:
                raise QueryError("aggregates don't go with these columns")
            if name in names:
                raise QueryError(f"two columns are named {name!r}")
            names.append(name)
        clash = [n for n in new if n in df.columns]
        for n in clash:  # the ORDER BY that follows means the source's column
            new["_new_" + n] = new.pop(n)
        out = df.withColumns(new) if new else df
        return out, [("_new_" + n if n in clash else n) for n in names]

    def finished(self, q: Select, out: DataFrame, names: list[str], scope: Scope, order: list[Column], key: str | None) -> DataFrame:
        plain = lambda n: n.removeprefix("_new_")
        keys: list[tuple[str, bool]] = []
        inner = Scope(self, out)
        for o in q.order:
            keys.append((inner.column(o.column), o.desc))
        smallest = q.join is not None  # joins sort null as the smallest value, other queries as the largest
        by = lambda c, desc: (c.desc_nulls_last() if smallest else c.desc_nulls_first()) if desc else (c.asc_nulls_first() if smallest else c.asc_nulls_last())
        sort = [by(F.col(f"`{c}`"), d) for c, d in keys]
        limit = q.limit if q.limit is not None else self.options.implicit_limit
        final = [F.col(f"`{n}`").alias(plain(n)) for n in names]
        if q.distinct:
            if sort and not all(c in names for c, _ in keys):
                rank = [(F.max if d else F.min)(F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))).alias(f"_sort{i}") for i, (c, d) in enumerate(keys)]
                out = out.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*rank)
                sort = [F.col(f"_sort{i}").desc() if d else F.col(f"_sort{i}").asc() for i, (_, d) in enumerate(keys)]
            else:
                out = out.select(*[F.col(f"`{n}`") for n in names]).distinct()
        else:
            if sort and key and key in out.columns and not q.group:
                sort.append(F.col(f"`{key}`").asc())
            elif not sort and order:
                sort = order
        if sort:
            out = out.orderBy(*sort)
        if q.offset:
            out = out.offset(q.offset)
        if limit is not None:
            out = out.limit(limit)
        return out.select(*final)


def uses(q: Any, name: str) -> bool:
    if isinstance(q, SetOp):
        return uses(q.left, name) or uses(q.right, name)
    if isinstance(q, With):
        return uses(q.body, name) or any(uses(b, name) for _, b in q.ctes)
    if isinstance(q, Select):
        if q.source == name or (isinstance(q.source, tuple) and uses(q.source[0], name)) or (q.join and q.join.table == name):
            return True
        return has_node(q.where, lambda e: isinstance(e, Sub) and uses(e.query, name))
    return False


def cost(q: Any) -> int:
    """A static measure of a query's size: what a budget is held against before anything runs."""
    if isinstance(q, SetOp):
        return 1 + cost(q.left) + cost(q.right)
    if isinstance(q, With):
        return 1 + cost(q.body) + sum(cost(b) for _, b in q.ctes)
    if not isinstance(q, Select):
        return 1
    total = 10 + len(q.items) + (100 if q.join and q.join.kind == "cross" else 20 if q.join else 0)
    total += (q.knn.k + 50 if q.knn else 0) + (50 * q.traverse[1] if q.traverse else 0)
    if isinstance(q.source, tuple):
        total += cost(q.source[0])
    stack = [q.where]
    while stack:
        e = stack.pop()
        total += 1
        if isinstance(e, Call):
            stack.extend(e.args)
        elif isinstance(e, tuple):
            stack.extend(e)
        elif isinstance(e, Sub):
            total += cost(e.query)
    return total
