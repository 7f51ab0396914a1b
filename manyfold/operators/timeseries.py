"""Time series: points with a time in whole milliseconds and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AGGREGATES = {"count": lambda v: F.count(v).cast("double"), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp with or without zone (taken as UTC in a UTC session)."""
    return F.unix_millis(ts.cast("timestamp"))


def time_bucket(ts: Column, width: int) -> Column:
    """The start of the bucket of width ms; floor, also before 1970."""
    if width <= 0:
        raise ValueError("a bucket has a width over 0")
    return ts - F.pmod(ts, F.lit(width))


def bucketed(df: DataFrame, ts: str, width: int, value: str | None = None, agg: str = "count", by: tuple[str, ...] = ()) -> DataFrame:
    """bucket_start, bucket_end and value per bucket that has a point. Without a value column every value is 0."""
    v = F.col(value).cast("double") if value else F.lit(0.0)
    b = time_bucket(F.col(ts), width)
    out = df.where(F.col(ts).isNotNull()).groupBy(*by, b.alias("bucket_start")).agg(AGGREGATES[agg](v).alias("value"))
    return out.select(*by, "bucket_start", (F.col("bucket_start") + width).alias("bucket_end"), "value")


def windows(df: DataFrame, ts: str, value: str, width: int, step: int | None = None, agg: str = "avg") -> DataFrame:
    """window_start and value of windows of width that begin every step ms from the first point up to the last; a point
    is counted in each that covers it. Windows without points aren't given."""
    step = step or width
    if width <= 0 or not 0 < step <= width:
        raise ValueError("a window has a width over 0 and a step up to it")
    first = df.agg(F.min(ts)).first()[0]
    if first is None:
        return df.select(F.lit(0).cast("long").alias("window_start"), F.lit(0.0).alias("value")).where(F.lit(False))
    at = F.col(ts) - F.lit(first)
    last = (at / step).cast("long") if step == 1 else F.floor(at / step)
    low = F.greatest(F.lit(0).cast("long"), F.floor((at - width) / step) + 1)
    starts = F.explode(F.sequence(low, last)).alias("_k")
    return df.where(F.col(ts).isNotNull()).select(starts, F.col(value).cast("double").alias("_v")).groupBy("_k").agg(AGGREGATES[agg](F.col("_v")).alias("value")).select((F.col("_k") * step + F.lit(first)).alias("window_start"), "value")


def resampled(df: DataFrame, ts: str, value: str, start: int, end: int, step: int, fill: str = "previous", by: tuple[str, ...] = ()) -> DataFrame:
    """ts and value on the grid start, start + step, ... before end. previous: the last point up to there; null: only
    points just there. Of points of one time the largest value counts.

    Each point is put on the first grid place that it is known at; places are then filled by one ordered pass (per
    key, if there is one; points of a long single series are reduced to one a place first)."""
    if step <= 0:
        raise ValueError("a step is over 0")
    points = df.where(F.col(ts).isNotNull() & (F.col(ts) < end)).groupBy(*by, F.col(ts).alias("_t")).agg(F.max(F.col(value).cast("double")).alias("_v"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = df.sparkSession.range(start, end, step).select(F.col("id").alias("ts"))
    cells = keys.crossJoin(grid) if by else grid
    if fill == "null":
        return cells.join(points.withColumnRenamed("_t", "ts"), [*by, "ts"], "left").select(*by, "ts", F.col("_v").alias("value"))
    place = F.greatest(F.lit(start).cast("long"), F.lit(start) + F.ceil((F.col("_t") - F.lit(start)) / step) * step)
    known = points.withColumn("ts", place).groupBy(*by, "ts").agg(F.max_by("_v", "_t").alias("value"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    filled = cells.join(known, [*by, "ts"], "left")
    return filled.select(*by, "ts", F.last("value", ignorenulls=True).over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation over n - 1."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    return F.percentile(value, F.lit(p / 100))


def rate(df: DataFrame, ts: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ts and the change of value a second since the point before (by ts, then value); points of one time give none."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(ts, value)
    out = df.select(*by, F.col(ts).alias("ts"), F.col(value).cast("double").alias("_v"), F.lag(ts).over(w).alias("_t0"), F.lag(F.col(value).cast("double")).over(w).alias("_v0"))
    return out.where("_t0 is not null and ts > _t0").select(*by, "ts", ((F.col("_v") - F.col("_v0")) / ((F.col("ts") - F.col("_t0")) / 1000)).alias("rate"))


def moving_average(df: DataFrame, ts: str, value: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """ts and the mean of the last n values, from the first full window on; a shorter series is one window."""
    if n <= 0:
        raise ValueError("a window has a size over 0")
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(ts, value)
    out = df.select(*by, F.col(ts).alias("ts"), F.avg(F.col(value).cast("double")).over(w.rowsBetween(-(n - 1), 0)).alias("average"), F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(part).alias("_n"))
    return out.where(F.col("_k") >= F.least(F.lit(n), F.col("_n"))).select(*by, "ts", "average")


def downsampled(df: DataFrame, ts: str, value: str, n: int, agg: str = "avg", by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of n rows in order of time, the last one shorter: ts (mean, whole) and value; n = 0: as it is."""
    if not n:
        return df.select(*by, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(ts, value)
    chunk = F.floor((F.row_number().over(w) - 1) / n)
    out = df.select(*by, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"), chunk.alias("_c")).groupBy(*by, "_c")
    return out.agg(F.floor(F.avg("_t")).alias("ts"), AGGREGATES[agg](F.col("_v")).alias("value")).select(*by, "ts", "value")


def retained(df: DataFrame, ts: str, now: int, ttl: int) -> DataFrame:
    return df.where(F.col(ts) >= now - ttl)


def aged(df: DataFrame, ts: str, value: str, now: int, ttl: int, n: int) -> DataFrame:
    """Points of the last ttl ms as they are, older ones in chunks of n."""
    fresh = retained(df, ts, now, ttl).select(F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return downsampled(df.where(F.col(ts) < now - ttl), ts, value, n).unionByName(fresh)


def partials(df: DataFrame, ts: str, value: str, width: int) -> DataFrame:
    """bucket_start, n, total, low, high: what a continuous aggregate keeps; partials of parts merge by `merged`."""
    v = F.col(value).cast("double")
    return df.where(F.col(ts).isNotNull()).groupBy(time_bucket(F.col(ts), width).alias("bucket_start")).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("bucket_start")
    return both.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def read_aggregate(parts: DataFrame) -> DataFrame:
    return parts.withColumn("mean", F.col("total") / F.nullif(F.col("n"), F.lit(0)))
