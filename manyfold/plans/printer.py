"""Queries as lines of text: what EXPLAIN shows before Spark's own plan."""

from __future__ import annotations

from typing import Any

from .ast import Agg, Call, Case, Col, Lit, Select, SetOp, Sub, Var, With


def text_of(e: Any) -> str:
    if isinstance(e, Lit):
        return "NULL" if e.value is None else "'" + e.value.replace("'", "''") + "'" if isinstance(e.value, str) else str(e.value).upper() if isinstance(e.value, bool) else str(e.value)
    if isinstance(e, Var):
        return f"${e.name}"
    if isinstance(e, Col):
        return e.name
    if isinstance(e, Agg):
        return f"{e.func.upper()}({'*' if e.arg is None else text_of(e.arg)})"
    if isinstance(e, Case):
        inner = " ".join(f"WHEN {text_of(c)} THEN {text_of(v)}" for c, v in e.branches)
        return f"CASE {inner}{'' if e.other is None else ' ELSE ' + text_of(e.other)} END"
    if isinstance(e, Sub):
        return f"{text_of(e.of)} IN (...)" if e.kind == "in" else f"{e.kind.upper()}(...)"
    if isinstance(e, Call):
        if e.op == "not":
            return f"NOT {text_of(e.args[0])}"
        if e.op in ("isnull", "isnotnull"):
            return f"{text_of(e.args[0])} IS {'NOT ' if e.op == 'isnotnull' else ''}NULL"
        if e.op == "in":
            return f"{text_of(e.args[0])} IN ({', '.join(map(text_of, e.args[1]))})"
        if e.op == "between":
            return f"{text_of(e.args[0])} BETWEEN {text_of(e.args[1])} AND {text_of(e.args[2])}"
        if e.op in ("coalesce", "nullif", "match"):
            return f"{e.op.upper()}({', '.join(map(text_of, e.args))})"
        if e.op == "get":
            return f"{text_of(e.args[0])} -> '{'.'.join(e.args[1].value)}'"
        if e.op == "has":
            return f"{text_of(e.args[0])} @> ..."
        return "(" + f" {e.op.upper()} ".join(map(text_of, e.args)) + ")"
    return str(e)


def selectivity(e: Any, stats: dict) -> float:
    """The share of rows that a condition is thought to keep."""
    if e is None:
        return 1.0
    if isinstance(e, Call):
        if e.op == "and":
            return selectivity(e.args[0], stats) * selectivity(e.args[1], stats)
        if e.op == "or":
            a, b = selectivity(e.args[0], stats), selectivity(e.args[1], stats)
            return a + b - a * b
        if e.op == "not":
            return 1 - selectivity(e.args[0], stats)
        column = e.args[0].name if e.args and isinstance(e.args[0], Col) else None
        s = stats.get(column)
        if s and s["rows"]:
            if e.op == "=":
                return 1 / max(1, s["distinct"])
            if e.op in ("isnull", "isnotnull"):
                share = s["nulls"] / s["rows"]
                return share if e.op == "isnull" else 1 - share
            if e.op in ("<", "<=", ">", ">=") and s["histogram"] and isinstance(e.args[1], Lit) and isinstance(e.args[1].value, (int, float)):
                low, high = float(s["min"]), float(s["max"])
                at = min(1.0, max(0.0, (float(e.args[1].value) - low) / ((high - low) or 1))) * len(s["histogram"])
                below = sum(s["histogram"][: int(at)]) + (s["histogram"][int(at)] * (at % 1) if int(at) < len(s["histogram"]) else 0)
                share = below / s["rows"]
                return share if e.op[0] == "<" else 1 - share
    return 0.1


def describe(q: Any, tables: dict, stats: dict, indent: int = 0) -> list[str]:
    pad = "  " * indent
    if isinstance(q, SetOp):
        return [f"{pad}{q.op.upper()}{' ALL' if q.all else ''}", *describe(q.left, tables, stats, indent + 1), *describe(q.right, tables, stats, indent + 1)]
    if isinstance(q, With):
        return [line for n, b in q.ctes for line in [f"{pad}CTE {n}", *describe(b, tables, stats, indent + 1)]] + describe(q.body, tables, stats, indent)
    if not isinstance(q, Select):
        return [f"{pad}{q}"]
    source = q.source if isinstance(q.source, str) else q.source[1]
    own = stats.get(source, {})
    scan = "KnnScan" if q.knn else "TraverseScan" if q.traverse else "FullScan"
    lines = [f"{pad}{scan} {source}" + (f" WHERE {text_of(q.where)}" if q.where is not None else "")]
    if not isinstance(q.source, str):
        lines += describe(q.source[0], tables, stats, indent + 1)
    if q.join:
        lines.append(f"{pad}JOIN {q.join.kind} {q.join.table}" + (f" ON {'.'.join(q.join.left)} = {'.'.join(q.join.right)}" if q.join.left else ""))
    if q.knn:
        lines.append(f"{pad}KNN {q.knn.k} {q.knn.mode.upper()}")
    if q.group:
        lines.append(f"{pad}GROUP BY {', '.join(q.group)}")
    if q.order:
        lines.append(f"{pad}ORDER BY {', '.join(o.column + (' DESC' if o.desc else '') for o in q.order)}")
    if q.limit is not None:
        lines.append(f"{pad}LIMIT {q.limit}")
    if own:
        rows = next(iter(own.values()))["rows"]
        lines.append(f"{pad}ESTIMATED_ROWS {max(1, round(rows * selectivity(q.where, own)))}")
        lines.append(f"{pad}STATS {rows} rows, {len(own)} columns")
    return lines
