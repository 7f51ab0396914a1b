"""Relational operators whose meaning differs from Spark's own, or that Spark lacks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import settled


def equi_join(a: DataFrame, b: DataFrame, x: str, y: str, how: str) -> DataFrame:
    """Null keys meet nothing; nor do NaNs."""
    left, right = F.col(f"`{x}`"), F.col(f"`{y}`")
    on = left == right
    for df, c, col in ((a, x, left), (b, y, right)):
        if dict(df.dtypes)[c] in ("double", "float"):
            on = on & ~F.isnan(col)
    return a.join(b, on, how)


def _same(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    for c, t in a.dtypes:
        other = dict(b.dtypes)[c]
        ints = {"tinyint", "smallint", "int", "bigint"}
        if t != other and "void" not in (t, other) and not (t in ints and other in ints):
            raise ValueError(f"{c!r} is {t} on one side, {other} on the other")
    left, right = a.alias("l"), b.alias("r")
    on = F.lit(True)
    for c in a.columns:
        on = on & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left, right, on


def set_operation(op: str, all_: bool, a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns go by name. INTERSECT ALL and EXCEPT ALL keep every left row that has, or hasn't, an equal on the right:
    sets filter, they don't count (see bag_operation)."""
    left, right, on = _same(a, b)
    if op == "union":
        out = a.unionByName(b)
        return out if all_ else out.distinct()
    out = left.join(right, on, "left_semi" if op == "intersect" else "left_anti")
    return out if all_ else out.distinct()


def bag_operation(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Counting: the lesser count of each row, or the left count less the right."""
    b = b.select(*a.columns)
    return a.intersectAll(b) if op == "intersect" else a.exceptAll(b)


def in_subquery(df: DataFrame, of: Column, sub: DataFrame, negated: bool) -> DataFrame:
    """Rows whose value is (not) in the subquery's one column, by the rules for null: a semi-join, or a null-aware
    anti-join that knows from one aggregate whether the other side is empty or has a null."""
    s = sub.select(F.col(f"`{sub.columns[0]}`").alias("_in"))
    if not negated:
        return df.join(s, of == F.col("_in"), "left_semi")
    n, nulls = s.agg(F.count(F.lit(1)), F.count(F.when(F.col("_in").isNull(), 1))).first()
    if not n:
        return df
    if nulls:
        return df.where(F.lit(False))
    return df.where(of.isNotNull()).join(s, of == F.col("_in"), "left_anti")


def fixed_point(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 1000) -> DataFrame:
    """base and what step gives of what the turn before added, until it adds nothing, or after most turns. distinct
    drops what was there before. Each turn's rows are a written table."""
    names = base.columns
    seen = delta = settled(base.distinct() if distinct else base, "fixed-point")
    for _ in range(most):
        new = step(delta)
        if len(new.columns) != len(names):
            raise ValueError("the step has other columns than the base")
        new = new.select(*names) if set(new.columns) == set(names) else new.toDF(*names)
        new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in base.schema.fields])
        if distinct:
            left, right, on = _same(new, seen)
            new = left.join(right, on, "left_anti").distinct()
        delta = settled(new, "fixed-point")
        if delta.isEmpty():
            return seen
        seen = seen.unionByName(delta)
    logging.getLogger(__name__).warning("the recursion was ended after %d turns", most)
    return seen


def window_column(w: Any, kinds: dict[str, str], column: Callable[[str], str], key: str | None) -> Column:
    """A window function. Without a frame, and for RANGE, it sees the whole partition, ordered or not; nulls come last
    in rising order and first in falling; NTILE puts row p of n into p * tiles / n; bounds of ROWS frames stop at the
    partition's first and last row, so a frame that would lie outside holds the row at the edge."""
    part = W.partitionBy(*[F.col(f"`{column(c)}`") for c in w.partition]) if w.partition else W.partitionBy(F.lit(0))
    order = [F.col(f"`{column(o.column)}`").desc_nulls_first() if o.desc else F.col(f"`{column(o.column)}`").asc_nulls_last() for o in w.order]
    ties = [*order, *([F.col(f"`{key}`")] if key and key in kinds else [])] or [F.lit(0)]
    line = part.orderBy(*ties)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if w.func == "row_number":
        return F.row_number().over(line).cast("long")
    if w.func in ("rank", "dense_rank"):
        return (getattr(F, w.func)().over(part.orderBy(*order)) if order else F.lit(1)).cast("long")
    if w.func == "ntile":
        return (F.floor((F.row_number().over(line) - 1) * w.n / F.count(F.lit(1)).over(part)) + 1).cast("long")
    c = F.col(f"`{column(w.arg)}`")
    if w.func in ("lag", "lead"):
        return getattr(F, w.func)(c, w.n).over(line)
    if w.func in ("sum", "avg") and kinds[column(w.arg)] not in ("int", "float", "null"):
        raise ValueError(f"{w.func.upper()} takes numbers")
    f = w.frame
    calls = {
        "first_value": lambda over: F.first(c).over(over), "last_value": lambda over: F.last(c).over(over),
        "nth_value": lambda over: F.nth_value(c, w.n).over(over) if w.n else F.lit(None), "sum": lambda over: F.sum(c).over(over),
        "avg": lambda over: F.avg(c.cast("double")).over(over), "min": lambda over: F.min(c).over(over),
        "max": lambda over: F.max(c).over(over), "count": lambda over: F.count(c).over(over),
    }
    call = calls[w.func]
    if f is None or f.kind == "range":
        return call(whole)
    start, end = f.start, f.end
    low = W.unboundedPreceding if start is None else start
    high = W.unboundedFollowing if end is None else end
    at, back = F.row_number().over(line) - 1, F.count(F.lit(1)).over(part) - F.row_number().over(line)
    alone = lambda value: {"count": F.when(value.isNull(), 0).otherwise(1).cast("long"), "nth_value": value if w.n == 1 else F.lit(None)}.get(w.func, value.cast("double") if w.func == "avg" else value)
    first, last = alone(F.first(c).over(whole)), alone(F.last(c).over(whole))
    crossed = start is not None and end is not None and start > end
    normal = F.lit(None) if crossed else call(line.rowsBetween(low, high))
    if end is not None and end < 0:  # rows so near the partition's first one that the frame's end stops there
        reach = min(-end, -(start or 0)) if crossed and (start or 0) < 0 else -1 if crossed else -end
        return F.when(at <= reach, first).otherwise(normal)
    if start is not None and start > 0:
        reach = min(start, end or 0) if crossed else start
        return F.when(back <= reach, last).otherwise(normal)
    return normal
