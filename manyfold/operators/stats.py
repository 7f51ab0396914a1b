"""Column statistics in one pass over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 32


def analyzed(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, rows, nulls, distinct, min, max (as text) and, for numbers, 32 buckets of equal width. Counts and bounds
    are one aggregate, histograms another; exact=False counts distinct values by a sketch."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    ndv = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(plain):
        x = F.col(f"`{c}`")
        aggs += [F.count(F.when(x.isNull(), 1)).alias(f"nulls{i}"), ndv(x).alias(f"distinct{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    r = df.agg(*aggs).first()
    counts = []
    for i, c in enumerate(plain):
        low, high = r[f"min{i}"], r[f"max{i}"]
        if c in numeric and low is not None and low == low and high > low:
            width = (float(high) - float(low)) / BUCKETS
            b = F.least(F.lit(BUCKETS - 1), F.floor((F.col(f"`{c}`").cast("double") - float(low)) / width))
            counts += [F.count(F.when(b == k, 1)).alias(f"h{i}_{k}") for k in range(BUCKETS)]
    h = df.agg(*counts).first().asDict() if counts else {}
    rows = []
    for i, c in enumerate(plain):
        histogram = [h[f"h{i}_{k}"] for k in range(BUCKETS)] if f"h{i}_0" in h else None
        low, high = r[f"min{i}"], r[f"max{i}"]
        rows.append((c, r["rows"], r[f"nulls{i}"], r[f"distinct{i}"], None if low is None else str(low), None if high is None else str(high), histogram))
    schema = "`column` string, `rows` long, nulls long, `distinct` long, `min` string, `max` string, histogram array<long>"
    return df.sparkSession.createDataFrame(rows, schema)
