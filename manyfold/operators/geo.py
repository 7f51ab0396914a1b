"""Points and rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))


def in_rect(x: Column, y: Column, rect: tuple[float, float, float, float]) -> Column:
    """rect: x0, y0, x1, y1, bounds included. Plain comparisons, so they reach the scan."""
    return x.between(rect[0], rect[2]) & y.between(rect[1], rect[3])


def rect_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def rects_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def nearest(df: DataFrame, x: str, y: str, at: tuple[float, float], k: int, key: str) -> DataFrame:
    return df.withColumn("distance", euclidean(F.col(x), F.col(y), F.lit(at[0]), F.lit(at[1]))).orderBy("distance", key).limit(k)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    p, q = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(p) * F.sin(p) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(q) * F.sin(q)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _half(value: Column, low: float, high: float, bits: int) -> Column:
    """The number that bits halvings of [low, high] give."""
    cell = F.floor((value - low) / ((high - low) / (1 << bits)))
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), cell)).cast("long")


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Longitude and latitude bits by turns, five a character."""
    total = 5 * precision
    x, y = _half(lon, -180.0, 180.0, -(-total // 2)), _half(lat, -90.0, 90.0, total // 2)
    chars = []
    for c in range(precision):
        code = F.lit(0).cast("long")
        for i in range(5 * c, 5 * c + 5):
            n, source = (-(-total // 2), x) if i % 2 == 0 else (total // 2, y)
            code = code * 2 + F.shiftright(source, n - 1 - i // 2).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash_bounds(text: str) -> tuple[float, float, float, float] | None:
    """south, west, north, east; None for no geohash."""
    lat, lon, even = [-90.0, 90.0], [-180.0, 180.0], True
    for ch in text:
        v = _BASE32.find(ch)
        if v < 0:
            return None
        for bit in range(4, -1, -1):
            r = lon if even else lat
            r[1 - (v >> bit & 1)] = (r[0] + r[1]) / 2
            even = not even
    return lat[0], lon[0], lat[1], lon[1]


def hilbert(x: Column, y: Column, order: int) -> Column:
    """The place of a cell on the Hilbert curve, reflected by the size of each level less one."""
    x, y, d = x.cast("long"), y.cast("long"), F.lit(0).cast("long")
    size = 1 << max(0, order - 1)
    state = F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(s: Column, k: Column) -> Column:
        rx, ry = (s["x"].bitwiseAND(k) > 0).cast("long"), (s["y"].bitwiseAND(k) > 0).cast("long")
        d = s["d"] + k * k * (3 * rx).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, k - 1 - s["x"]).otherwise(s["x"]), F.when(rx == 1, k - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(s["x"]).alias("x"), F.when(ry == 0, fx).otherwise(s["y"]).alias("y"), d.alias("d"))

    levels = F.array(*[F.lit(1 << i).cast("long") for i in range(size.bit_length() - 1, -1, -1)])
    return F.aggregate(levels, state, step, lambda s: s["d"])
