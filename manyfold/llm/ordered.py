"""Documents in ascending order of id without a global sort: buckets by quantiles, ordered inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: However large the input: what is known of each bucket may come to the driver. Beyond, buckets grow; those who take
#: them work through a bucket row by row, so memory doesn't.
MOST_BUCKETS = 20_000


def boundaries(docs: DataFrame, rows_per_bucket: int) -> list[int]:
    """Ascending distinct ids; bucket b holds the ids over b - 1 boundaries. One bound for rows_per_bucket documents,
    fewer where that would make more than MOST_BUCKETS; only the id column is read."""
    n = docs.count()
    k = min(n // rows_per_bucket, MOST_BUCKETS - 1)
    if k < 1:
        return []
    shares = [(i + 1) / (k + 1) for i in range(k)]
    got = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in shares]), F.lit(max(10_000, 20 * k)))).first()[0]
    return sorted(set(got or []))


def bucket(doc_id: Column, bounds: list[int]) -> Column:
    """0 for a null id and ids up to the first boundary, and so on."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.coalesce(F.size(F.filter(array, lambda b: b < doc_id)), F.lit(0)) if len(bounds) < 64 else _searched(doc_id, bounds)


def _searched(doc_id: Column, bounds: list[int]) -> Column:
    """Binary search as nested conditions: a row passes about log2 of the bounds."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(doc_id > F.lit(bounds[m]), tree(m + 1, b)).otherwise(tree(a, m))

    return F.coalesce(tree(0, len(bounds)), F.lit(0))
