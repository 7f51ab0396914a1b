"""The engine: a catalogue of tables over one Spark session, and statements of the query dialect run against it."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import stats
from .plans.ast import Col, Command, QueryError, Var
from .plans.compiler import Compiler, Options, Scope, Table, cost, kind_of
from .plans.parser import parse, parse_script
from .plans.printer import describe
from .storage import settled

EDGES = "src_table string, src string, label string, dst_table string, dst string, payload string, ts_unix long"
#: A table changed so often is written out, so that its plan doesn't grow for ever.
SETTLE_EVERY = 10


class Prepared:
    """A statement with parameters ?, $1 or $name; kinds, if given, are checked on each run."""

    def __init__(self, engine: Engine, text: str, kinds: Sequence[str] = ()) -> None:
        self.engine, self.statement, self.kinds = engine, parse(text), tuple(kinds)

    def run(self, *values: Any, **named: Any) -> DataFrame:
        if self.kinds and len(values) != len(self.kinds):
            raise QueryError(f"{len(self.kinds)} values are needed, not {len(values)}")
        for v, k in zip(values, self.kinds):
            got = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
            if k != "any" and v is not None and got != k and not (k == "float" and got == "int"):
                raise QueryError(f"a value of kind {k} is needed, not {got}")
        return self.engine.run(self.statement, {**{str(i + 1): v for i, v in enumerate(values)}, **named})


class Engine:
    """Tables are versioned: each change makes a new DataFrame under a new transaction number, and older ones stay
    readable by `query_at`."""

    def __init__(self, spark: SparkSession, options: Options | None = None, budget: int = 100_000) -> None:
        self.spark, self.options, self.budget = spark, options or Options(), budget
        self.tables: dict[str, Table] = {}
        self.edges = spark.createDataFrame([], EDGES)
        self.tx = 0
        self.history: list[tuple[int, dict[str, Table], DataFrame]] = [(0, {}, self.edges)]
        self.views: dict[str, tuple[str, DataFrame]] = {}
        self.statistics: dict[str, dict] = {}
        self._cache: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self._changes: dict[str, int] = {}

    # -- catalogue

    def register(self, name: str, df: DataFrame, key: str | None = None, doc: str | None = None, vector: str | None = None, metric: str = "l2") -> None:
        for c in (key, doc, vector):
            if c and c not in df.columns:
                raise QueryError(f"{name!r} has no column {c!r}")
        self._commit(tables={**self.tables, name: Table(df, key, doc, vector, metric)})

    def create_table(self, name: str, columns: dict[str, str], key: str | None = None) -> None:
        """An empty table; kinds: bool, int, float, text."""
        types = {"bool": "boolean", "int": "long", "float": "double", "text": "string"}
        self.register(name, self.spark.createDataFrame([], ", ".join(f"`{c}` {types[k]}" for c, k in columns.items())), key)

    def add_column(self, name: str, column: str, kind: str) -> None:
        """Old rows read null."""
        t = self._table(name)
        types = {"bool": "boolean", "int": "long", "float": "double", "text": "string"}
        self._commit(tables={**self.tables, name: replace(t, df=t.df.withColumn(column, F.lit(None).cast(types[kind])))})

    def set_edges(self, edges: DataFrame) -> None:
        """Edges of all tables: src_table, src, label, dst_table, dst, payload (JSON), ts_unix."""
        self._commit(edges=edges.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EDGES.split(", ")]))

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"no table {name!r}")
        return self.tables[name]

    def _commit(self, tables: dict[str, Table] | None = None, edges: DataFrame | None = None) -> None:
        self.tx += 1
        self.tables = self.tables if tables is None else tables
        self.edges = self.edges if edges is None else edges
        self.history.append((self.tx, self.tables, self.edges))
        self._cache.clear()

    def _changed(self, name: str, df: DataFrame) -> None:
        self._changes[name] = self._changes.get(name, 0) + 1
        if self._changes[name] % SETTLE_EVERY == 0:
            df = settled(df, name)
        self._commit(tables={**self.tables, name: replace(self._table(name), df=df)})

    # -- queries

    def query(self, text: str, **variables: Any) -> DataFrame:
        return self.run(parse(text), variables)

    def script(self, text: str, **variables: Any) -> DataFrame | None:
        """Statements with shared variables; the last one's rows."""
        out, shared = None, dict(variables)
        for statement in parse_script(text):
            out = self.run(statement, shared)
        return out

    def prepare(self, text: str, kinds: Sequence[str] = ()) -> Prepared:
        return Prepared(self, text, kinds)

    def stream(self, text: str, **variables: Any) -> Iterator[Row]:
        """Rows one by one, without the implicit limit, a partition at a time on the driver."""
        yield from self._compiler(variables, replace(self.options, implicit_limit=None)).query(parse(text)).toLocalIterator()

    def query_at(self, text: str, tx: int) -> DataFrame:
        """As the tables were after transaction tx."""
        at = [h for h in self.history if h[0] <= tx]
        if not at:
            raise QueryError(f"no transaction {tx}")
        return Compiler(at[-1][1], {}, self.options, at[-1][2]).query(parse(text))

    def cached(self, text: str, ttl: float = 60.0, capacity: int = 64) -> DataFrame:
        """The rows of a query kept for ttl seconds, or until a table changes; the least lately used go first."""
        key = (text, self.tx)
        if key in self._cache and time.monotonic() - self._cache[key][0] < ttl:
            self._cache.move_to_end(key)
            return self._cache[key][1]
        self._cache[key] = (time.monotonic(), self.query(text).cache())
        while len(self._cache) > capacity:
            self._cache.popitem(last=False)[1][1].unpersist()
        return self._cache[key][1]

    def with_timeout(self, text: str, seconds: float) -> list[Row]:
        """Collected rows; the jobs are cancelled when time is up."""
        group = f"manyfold-{time.time_ns()}"
        sc = self.spark.sparkContext
        timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
        sc.setJobGroup(group, text[:100], True)
        timer.start()
        try:
            return self.query(text).collect()
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _compiler(self, variables: dict[str, Any], options: Options | None = None) -> Compiler:
        return Compiler({**self.tables, **{n: Table(df) for n, (_, df) in self.views.items()}}, variables, options or self.options, self.edges)

    def run(self, statement: Any, variables: dict[str, Any]) -> DataFrame:
        if not isinstance(statement, Command):
            if cost(statement) > self.budget:
                raise QueryError(f"the query costs {cost(statement)}, over the budget of {self.budget}")
            return self._compiler(variables).query(statement)
        return getattr(self, f"_{statement.kind}")(statement.args, variables)

    def _text(self, lines: list[str], name: str = "plan") -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in lines], f"{name} string")

    def _explain(self, a: dict, variables: dict) -> DataFrame:
        df = self._compiler(variables).query(a["query"])
        physical = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self._text([*describe(a["query"], self.tables, self.statistics), f"COST {cost(a['query'])}", *physical.splitlines()])

    def explain_analyze(self, text: str) -> list[str]:
        statement, began = parse(text), time.monotonic()
        rows = self._compiler({}).query(statement).count()
        return [*describe(statement, self.tables, self.statistics), f"ACTUAL_ROWS {rows}", f"ACTUAL_TIME_MS {round((time.monotonic() - began) * 1000)}"]

    def _analyze(self, a: dict, variables: dict) -> DataFrame:
        out = settled(stats.analyzed(self._table(a["table"]).df), "statistics")
        self.statistics[a["table"]] = {r["column"]: r.asDict() for r in out.collect()}  # one row per column
        return out

    def _drop_table(self, a: dict, variables: dict) -> DataFrame:
        self._table(a["table"])
        self._commit(tables={n: t for n, t in self.tables.items() if n != a["table"]})
        return self._text([])

    def _drop_index(self, a: dict, variables: dict) -> DataFrame:
        return self._text([])  # scans prune by Parquet statistics; there is no index to drop

    def _let(self, a: dict, variables: dict) -> DataFrame:
        variables[a["name"]] = self._value(a["expr"], variables)
        return self._text([])

    def _return(self, a: dict, variables: dict) -> DataFrame:
        one = self.spark.range(1)
        return one.select(Scope(self._compiler(variables), one).expr(a["expr"])[0].alias("value"))

    def _value(self, e: Any, variables: dict) -> Any:
        return self._return({"expr": e}, variables).first()[0]

    # -- changes

    def _literal(self, e: Any, variables: dict) -> Any:
        if isinstance(e, Var):
            if e.name not in variables:
                raise QueryError(f"no variable ${e.name}")
            return variables[e.name]
        return e.value

    def _affected(self, df: DataFrame, returning: tuple | None) -> DataFrame:
        if returning is None:
            return self.spark.createDataFrame([(df.count(),)], "affected long")
        return df if returning == ("*",) else df.select(*returning)

    def _new_rows(self, t: Table, a: dict, variables: dict) -> DataFrame:
        columns = a["columns"] or tuple(t.df.columns)
        if set(columns) != set(t.df.columns) - t.hidden and set(columns) != set(t.df.columns):
            raise QueryError(f"the columns are {', '.join(t.df.columns)}")
        kinds = {f.name: kind_of(f.dataType) for f in t.df.schema.fields}
        rows = []
        for r in a["rows"]:
            if len(r) != len(columns):
                raise QueryError(f"{len(r)} values for {len(columns)} columns")
            row = dict(zip(columns, (self._literal(x, variables) for x in r)))
            for c, v in row.items():
                got = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
                if got not in ("null", kinds[c]) and not (got == "int" and kinds[c] == "float"):
                    raise QueryError(f"{c!r} takes {kinds[c]}, not {got}")
                row[c] = float(v) if got == "int" and kinds[c] == "float" else v
            rows.append(tuple(row.get(c) for c in t.df.columns))
        return self.spark.createDataFrame(rows, t.df.schema)

    def insert_many(self, name: str, rows: DataFrame) -> None:
        t = self._table(name)
        self._changed(name, t.df.unionByName(rows.select(*t.df.columns)))

    def _insert(self, a: dict, variables: dict) -> DataFrame:
        name, t = a["table"], self._table(a["table"])
        new = self._new_rows(t, a, variables)
        if a["conflict"] is None:
            self._changed(name, t.df.unionByName(new))
            return self._affected(new, a["returning"])
        keys, sets = a["conflict"]
        on = F.lit(True)
        for k in keys:
            if k not in t.df.columns:
                raise QueryError(f"unknown column {k!r}")
            on = on & F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        old, fresh = t.df.alias("o"), F.broadcast(new).alias("n")  # a statement's literals
        if old.join(fresh, on).groupBy(*[F.col(f"n.`{k}`") for k in keys]).count().where("count > 1").limit(1).count():
            raise QueryError("ambiguous: several rows have that key")
        added = new.alias("n").join(t.df.alias("o"), on, "left_anti")
        if not sets:
            self._changed(name, t.df.unionByName(added))
            return self._affected(added, a["returning"])
        changed = dict(sets)
        values = []
        for f in t.df.schema.fields:
            c = F.col(f"o.`{f.name}`")
            if f.name in changed:
                v = changed[f.name]
                new_value = F.col(f"n.`{v.name.split('.', 1)[1]}`") if isinstance(v, Col) else F.lit(self._literal(v, variables))
                c = F.when(F.col("_hit"), new_value.cast(f.dataType)).otherwise(c)
            values.append(c.alias(f.name))
        merged = old.join(F.broadcast(new.withColumn("_hit", F.lit(True))).alias("n"), on, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        touched = merged.where("_hit").select(*values)
        result = settled(merged.select(*values).unionByName(added), name)
        out = settled(touched.unionByName(added), "returning")
        self._changed(name, result)
        return self._affected(out, a["returning"])

    def _where(self, t: Table, where: Any, variables: dict) -> Any:
        if where is None:
            return F.lit(True)
        return F.coalesce(Scope(self._compiler(variables), t.df, t).condition(where), F.lit(False))

    def _update(self, a: dict, variables: dict) -> DataFrame:
        name, t = a["table"], self._table(a["table"])
        test = self._where(t, a["where"], variables)
        sets = {}
        for c, v in a["set"]:
            if c not in t.df.columns or isinstance(v, Col):
                raise QueryError(f"{c!r} can't be set so")
            sets[c] = F.lit(self._literal(v, variables)).cast(t.df.schema[c].dataType)
        out = t.df.where(test).withColumns(sets)
        self._changed(name, t.df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in sets.items()}))
        return self._affected(out, a["returning"])

    def _delete(self, a: dict, variables: dict) -> DataFrame:
        name, t = a["table"], self._table(a["table"])
        test = self._where(t, a["where"], variables)
        self._changed(name, t.df.where(~test))
        return self._affected(t.df.where(test), a["returning"])

    def _relate(self, a: dict, variables: dict) -> DataFrame:
        (st, s), (dt, d) = a["from"], a["to"]
        payload = None if a["payload"] is None else json.dumps(a["payload"], sort_keys=True)
        same = (F.col("src_table") == st) & (F.col("src") == s) & (F.col("label") == a["label"]) & (F.col("dst_table") == dt) & (F.col("dst") == d)
        for table, node in ((st, s), (dt, d)):
            t = self._table(table)
            if t.key and t.df.where(F.col(t.key).cast("string") == node).isEmpty():
                raise QueryError(f"{table}:{node} isn't there")
        there = self.edges.where(same).first()
        if there is not None:
            conflict = a["conflict"]
            if conflict == "nothing":
                return self._text([])
            if isinstance(conflict, dict):
                new = F.lit(json.dumps(conflict["payload"], sort_keys=True))
                self._commit(edges=self.edges.withColumn("payload", F.when(same, new).otherwise(F.col("payload"))))
            elif (there["payload"], there["ts_unix"]) != (payload, a["ts"]):
                raise QueryError("EDGE_CONFLICT: the edge is there with other fields")
            return self._text([])
        row = self.spark.createDataFrame([(st, s, a["label"], dt, d, payload, a["ts"])], EDGES)
        self._commit(edges=self.edges.unionByName(row))
        return self._text([])

    # -- materialised views

    def create_view(self, name: str, text: str) -> None:
        if name in self.views or name in self.tables:
            raise QueryError(f"{name!r} is taken")
        self.views[name] = (text, settled(self.query(text), name))

    def refresh_view(self, name: str) -> dict[str, int]:
        """Rows inserted, deleted and unchanged, as bags."""
        if name not in self.views:
            raise QueryError(f"no view {name!r}")
        text, old = self.views[name]
        new = settled(self.query(text), name)
        self.views[name] = (text, new)
        count = lambda df, to: df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(to))
        a, b = count(old, "_a").alias("a"), count(new, "_b").alias("b")
        on = F.lit(True)
        for c in new.columns:
            on = on & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        x, y = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
        r = a.join(b, on, "full").agg(F.sum(F.greatest(y - x, F.lit(0))), F.sum(F.greatest(x - y, F.lit(0))), F.sum(F.least(x, y))).first()
        return {"inserted": r[0] or 0, "deleted": r[1] or 0, "unchanged": r[2] or 0}

    def drop_view(self, name: str) -> None:
        if self.views.pop(name, None) is None:
            raise QueryError(f"no view {name!r}")


__all__ = ["Engine", "Options", "Prepared"]
