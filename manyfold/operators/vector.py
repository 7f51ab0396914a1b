"""Vectors: distances, exact and two-stage nearest neighbours, inverted-file and product-quantised indexes, embedders."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

METRICS = ("l2", "cosine", "ip")


def _array(v: Column | Sequence[float]) -> Column:
    return v if isinstance(v, Column) else F.lit([float(x) for x in v]).cast("array<double>")


def dot(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(_array(a), _array(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | Sequence[float]) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column | Sequence[float], b: Column | Sequence[float], metric: str = "l2") -> Column:
    """l2; cosine, 1 where a norm is 0; ip, the negative inner product. Sizes that differ give null."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    if metric == "l2":
        d = F.sqrt(F.aggregate(F.zip_with(_array(a), _array(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    elif metric == "ip":
        d = -dot(a, b)
    else:
        n = norm(a) * norm(b)
        d = F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)
    return d


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def knn(df: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "l2", key: str | None = None, where: Column | None = None) -> DataFrame:
    """The k rows nearest to the query, with `distance`, nearest first, ties by key: each task keeps k rows."""
    if k <= 0:
        return df.withColumn("distance", F.lit(0.0)).where(F.lit(False))
    df = df if where is None else df.where(where)
    order = [F.col("distance"), *([F.col(key)] if key else [])]
    return df.where(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), query, metric)).orderBy(*order).limit(k)


def one_query(df: DataFrame, query: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")


def _first(pairs: DataFrame, n: int, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


# Searches for many queries. Rows and queries travel in blocks, once each through a shuffle; a task meets some blocks of
# queries with some or all blocks of rows, and keeps k rows a query. Only its time grows with rows times queries.

#: Components in a block of rows, and of queries: 2,048 and 1,024 rows of 64. Rows that are sorted before they are cut.
ROWS, QUERIES, SORTED = 1 << 17, 1 << 16, 1 << 15
#: Pairs that are measured at a time.
PAIRS = 1 << 18

#: What a method says of a block: pieces (queries, rows, estimate, may), each with indices of queries, a slice of rows, an
#: estimate to be ranked among one query's, and may(reach): which pairs can't be ruled out beyond each query's reach.
Piece = tuple[np.ndarray, slice, np.ndarray, Callable[[np.ndarray], np.ndarray]]
Method = Callable[["_Queries", np.ndarray, pa.StructArray], Iterator[Piece]]


def _matrix(rows: pa.StructArray, vector: str) -> np.ndarray:
    """Vectors of one size; a null component is NaN, so that its row comes last."""
    return np.asarray(rows.field(vector).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


def _blocks(df: DataFrame, vector: str, most: int, by: str | None = None) -> DataFrame:
    """df's rows as arrays (column by vector's name) of up to most components, of one size of vector each, and sorted by `by`; without null vectors."""
    kind = T.StructType([T.StructField(f"_{vector}", T.ArrayType(df.schema))])

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        sizes = np.array(pa.compute.list_value_length(rows[vector]).to_numpy())
        order = np.lexsort((rows[by].to_numpy(), sizes)) if by else np.argsort(sizes, kind="stable")
        struct, sizes = rows.take(pa.array(order)).to_struct_array().combine_chunks(), sizes[order]
        for size in np.unique(sizes):
            at, end, step = int(np.searchsorted(sizes, size)), int(np.searchsorted(sizes, size, "right")), max(1, most // max(1, int(size)))
            for i in range(at, end, step):
                part = pa.concat_arrays([struct.slice(i, min(step, end - i))])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], [f"_{vector}"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= SORTED or sum(x.nbytes for x in held) >= 1 << 26:
                yield from cut(pa.Table.from_batches(held))
                held = []
        if any(map(len, held)):
            yield from cut(pa.Table.from_batches(held))

    return df.where(F.col(vector).isNotNull()).mapInArrow(pack, kind)


def _ranks(keys: pa.Array) -> np.ndarray:
    """Numbers in the keys' order, nulls first."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return keys.to_numpy()
    values = keys.to_pylist()
    order = {v: i for i, v in enumerate(sorted(set(values), key=lambda v: (v is not None, v if v is not None else 0)))}
    return np.array([order[v] for v in values], np.int64)


class _Least:
    """The n least values of each query with what belongs to them, ties by key."""

    def __init__(self, queries: int, n: int, key: str | None = None) -> None:
        self.n, self.key, self.at, self.value, self.rows = n, key, np.empty(0, np.int64), np.empty(0), None
        self.limit = np.full(queries, np.inf)

    def offer(self, at: np.ndarray, value: np.ndarray, rows: pa.StructArray | None = None) -> None:
        if not len(at):
            return
        at, value = np.concatenate([self.at, at]), np.concatenate([self.value, value])
        if rows is not None and self.rows is not None:
            rows = pa.concat_arrays([self.rows, rows])
        order = np.lexsort((value, at) if rows is None else (_ranks(rows.field(self.key)), value, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        order, last = order[rank < self.n], order[rank == self.n - 1]
        self.limit[at[rank == self.n - 1]] = value[last]
        self.at, self.value = at[rank < self.n], value[order]
        self.rows = None if rows is None else rows.take(pa.array(order))


class _Queries:
    """A block of queries, and what has been found for them."""

    def __init__(self, block: pa.StructArray, k: int, oversample: int, key: str) -> None:
        self.ids, self.q = block.field("query_id"), _matrix(block, "query")
        self.q2, self.few, self.best = (self.q**2).sum(1), _Least(len(block), max(1, oversample) * k, None), _Least(len(block), k, key)
        self.kept: dict[str, np.ndarray] = {}

    def measure(self, x: np.ndarray, rows: pa.StructArray, at: np.ndarray, row: np.ndarray) -> None:
        """Offers pairs, their distances summed in the order in which distance() does."""
        xt, qt = np.ascontiguousarray(x.T), np.ascontiguousarray(self.q.T)
        for i in range(0, len(at), PAIRS):
            a, r = at[i : i + PAIRS], row[i : i + PAIRS]
            total = np.zeros(len(a))
            for xs, qs in zip(xt, qt):
                apart = xs[r] - qs[a]
                total += apart * apart
            d = np.sqrt(total)
            near = ~(d > self.best.limit[a])
            self.best.offer(a[near], d[near], rows.take(pa.array(r[near])))

    def search(self, rows: pa.StructArray, vector: str, method: Method) -> None:
        """Measures the rows that are best by estimate so far, then all that may lie as near as the k-th found."""
        x = _matrix(rows, vector)
        if x.shape[1] != self.q.shape[1]:
            return
        for at, part, estimate, may in method(self, x, rows):
            y, mine = x[part], rows.slice(part.start, part.stop - part.start)
            few = estimate < self.few.limit[at][:, None]
            n = self.few.n
            if n < few.shape[1] and few.sum() > 8 * n * len(at):
                some = np.zeros_like(few)
                np.put_along_axis(some, np.argpartition(estimate, n - 1, axis=1)[:, :n], True, axis=1)
                few &= some
            a, r = np.nonzero(few)
            self.few.offer(at[a], estimate[a, r])
            self.measure(y, mine, at[a], r)
            reach = self.best.limit[at]
            apart = (-2 * self.q[at]) @ y.T  # and the squares of both, with a slack for rounding
            apart += (1 - 1e-9) * (y**2).sum(1)
            near = ~(apart > (reach**2 - (1 - 1e-9) * self.q2[at])[:, None])
            near &= may(reach)
            near &= ~few
            a, r = np.nonzero(near)
            self.measure(y, mine, at[a], r)


def _search(df: DataFrame, vector: str, queries: DataFrame, k: int, key: str, oversample: int, method: Method, by: str | None = None) -> DataFrame:
    """For each query (query_id, each once, and query) the k nearest rows of its size by L2, ties by key, with query_id and
    `distance`: exact, as the method may only rule out what can't be among them."""
    spark, queries = df.sparkSession, queries.select("query_id", "query").where(F.col("query").isNotNull())
    if k <= 0:
        return df.crossJoin(queries.select("query_id").limit(0)).withColumn("distance", F.lit(0.0))
    size, n = queries.agg(F.max(F.size("query")), F.count(F.lit(1))).first()
    asked = -(-n // max(1, QUERIES // max(1, size or 0)))
    if asked > 1:
        tasks = -(-3 * spark.sparkContext.defaultParallelism // asked)
        few = _blocks(queries.repartition(asked), "query", QUERIES).repartition(asked)
        pairs = _blocks(df, vector, ROWS, by).repartition(tasks).hint("shuffle_replicate_nl").crossJoin(few)
    else:
        pairs = _blocks(df, vector, ROWS, by).crossJoin(F.broadcast(_blocks(queries.coalesce(1), "query", QUERIES)))
    kind = T.StructType([*df.schema, queries.schema["query_id"], T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, _Queries] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                blocks, asks = batch.column(0), batch.column(1)
                for i in range(len(batch)):
                    ask = asks.slice(i, 1).flatten()
                    it = (len(ask), ask.field("query_id")[0].as_py())
                    if it not in found:
                        found[it] = _Queries(ask, k, oversample, key)
                    found[it].search(blocks.slice(i, 1).flatten(), vector, method)
        for x in found.values():
            for i in range(0, len(x.best.at), 1000):
                rows = x.best.rows.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*rows.flatten(), x.ids.take(pa.array(x.best.at[i : i + 1000])), pa.array(x.best.value[i : i + 1000])], kind.names)

    return _first(pairs.mapInArrow(run, kind), k, "distance", key)


def knn_quantized_many(df: DataFrame, vector: str, queries: DataFrame, k: int, key: str, oversample: int = 4) -> DataFrame:
    """The k rows nearest by L2 to each of queries (query_id, each once, and query), with query_id and `distance`; exact.
    An estimate from signs and norm keeps oversample * k rows; the k-th of these then is a bound, and rows that by signs
    and norm may lie within it are measured."""

    def method(ask: _Queries, x: np.ndarray, rows: pa.StructArray) -> Iterator[Piece]:
        q, q2, c = ask.q, ask.q2, np.sqrt((x**2).sum(1))
        signs = np.where(x >= 0, 1.0, -1.0)
        estimate = q @ (signs * (-2 * c * math.sqrt(2 / (math.pi * max(1, x.shape[1]))))[:, None]).T
        estimate += c * c

        def may(reach: np.ndarray) -> np.ndarray:
            # a product with the query is most where the vector lies along those of the query's components that have its signs
            agree = np.where(q >= 0, q * q, -q * q) @ (signs > 0).astype(np.float64).T
            agree += np.where(q >= 0, 0.0, q * q).sum(1)[:, None]
            least = np.sqrt(np.maximum(agree, 0, out=agree), out=agree)
            least *= -2 * c
            least += c * c
            return ~(least > ((reach + 1e-6 * (c.max() + np.sqrt(q2))) ** 2 - q2)[:, None])

        yield np.arange(len(q)), slice(0, len(x)), estimate, may

    return _search(df, vector, queries, k, key, oversample, method)


def knn_quantized(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, oversample: int = 4) -> DataFrame:
    """As knn_quantized_many, for one query; nearest first."""
    return knn_quantized_many(df, vector, one_query(df, query), k, key, oversample).drop("query_id").orderBy("distance", key)


class Ivf:
    """An inverted file: vectors by nearest of n_lists centroids, learned by k-means on at most sample rows. A search
    measures the probes nearest lists, and of the others the rows that by their own and the query's distance from the
    centroid may lie as near as the k-th found there: exact."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    @classmethod
    def fit(cls, df: DataFrame, vector: str, n_lists: int, sample: int = 100_000, seed: int = 1) -> Ivf:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).orderBy(F.xxhash64(F.col(vector))).limit(sample)
        model = KMeans(k=n_lists, seed=seed, maxIter=10).fit(rows)
        return cls(np.array(model.clusterCenters()))

    def assign(self, df: DataFrame, vector: str, to: str = "list_id") -> DataFrame:
        """df with the list, and in `to`_far the distance from its centroid."""
        centroids = self.centroids

        @F.pandas_udf("list int, far double")
        def lists(v: pd.Series) -> pd.DataFrame:
            x = np.array(v.tolist(), dtype=np.float64).reshape(len(v), centroids.shape[1])
            near = ((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :]).argmin(1)
            return pd.DataFrame({"list": near.astype(np.int32), "far": np.sqrt(((x - centroids[near]) ** 2).sum(1))})

        out = df.where(F.size(vector) == centroids.shape[1]).withColumn("_list", lists(F.col(vector)))
        return out.withColumns({to: F.col("_list.list"), f"{to}_far": F.col("_list.far")}).drop("_list")

    def search_many(self, assigned: DataFrame, vector: str, queries: DataFrame, k: int, probes: int, key: str, to: str = "list_id") -> DataFrame:
        """For each of queries (query_id, each once, and query) the k nearest rows by L2, with query_id and `distance`."""
        centroids = self.centroids

        def method(ask: _Queries, x: np.ndarray, rows: pa.StructArray) -> Iterator[Piece]:
            if "apart" not in ask.kept:
                far = np.sqrt(((ask.q[:, None, :] - centroids[None]) ** 2).sum(2)) if len(centroids) * ask.q.size <= 1 << 24 else np.array([np.sqrt(((centroids - q) ** 2).sum(1)) for q in ask.q])
                ask.kept["apart"], ask.kept["probed"] = far, np.zeros(far.shape, bool)
                np.put_along_axis(ask.kept["probed"], np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
            lists, own = np.asarray(rows.field(to)), np.asarray(rows.field(f"{to}_far"))
            ends = [0, *(np.flatnonzero(np.diff(lists)) + 1), len(lists)]
            for start, stop in zip(ends, ends[1:]):
                mine, apart, probed = own[start:stop], ask.kept["apart"][:, lists[start]], ask.kept["probed"][:, lists[start]]
                slack = 1e-9 * (mine.max() + apart)
                at = np.flatnonzero(probed | ~((mine.min() - apart > ask.best.limit + slack) | (apart - mine.max() > ask.best.limit + slack)))
                if not len(at):
                    continue
                estimate = (-2 * ask.q[at]) @ x[start:stop].T
                estimate += (x[start:stop] ** 2).sum(1)
                estimate[~probed[at]] = np.inf

                def may(reach: np.ndarray, mine: np.ndarray = mine, apart: np.ndarray = apart[at], slack: np.ndarray = slack[at], probed: np.ndarray = probed[at]) -> np.ndarray:
                    return probed[:, None] | ~(np.abs(mine - apart[:, None]) > (reach + slack)[:, None])

                yield at, slice(int(start), int(stop)), estimate, may

        queries = queries.where(F.size("query") == centroids.shape[1])
        return _search(assigned, vector, queries, k, key, 1, method, to).drop(f"{to}_far")

    def search(self, assigned: DataFrame, vector: str, query: Sequence[float], k: int, probes: int, key: str, to: str = "list_id") -> DataFrame:
        return self.search_many(assigned, vector, one_query(assigned, query), k, probes, key, to).drop("query_id").orderBy("distance", key)


class ProductQuantizer:
    """Vectors as one byte per subspace. A search estimates distances by table, measures the best, and then all rows that
    by estimate and error of their codes may lie as near as the k-th of these: exact."""

    def __init__(self, codebooks: np.ndarray) -> None:
        self.codebooks = codebooks  # parts x codes x width

    @classmethod
    def fit(cls, df: DataFrame, vector: str, parts: int, codes: int = 16, sample: int = 10_000, rounds: int = 8) -> ProductQuantizer:
        x = np.array([r[0] for r in df.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(F.col(vector))).limit(sample).collect()], np.float64)
        width, books = x.shape[1] // parts, []
        for p in range(parts):
            sub = x[:, p * width : (p + 1) * width]
            c = sub[np.linspace(0, len(sub) - 1, min(codes, len(sub))).astype(int)].copy()
            for _ in range(rounds):
                near = ((sub[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
                for i in range(len(c)):
                    if (near == i).any():
                        c[i] = sub[near == i].mean(0)
            books.append(c)
        return cls(np.array(books))

    def encode(self, df: DataFrame, vector: str, to: str = "pq") -> DataFrame:
        books = self.codebooks

        @F.pandas_udf("codes array<int>, error double")
        def encode(v: pd.Series) -> pd.DataFrame:
            x = np.array(v.tolist(), np.float64).reshape(len(v), len(books), books.shape[2])
            d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
            return pd.DataFrame({"codes": list(d.argmin(2).astype(np.int32)), "error": np.sqrt(d.min(2).sum(1))})

        out = df.withColumn("_pq", encode(F.col(vector)))
        return out.withColumns({to: F.col("_pq.codes"), f"{to}_error": F.col("_pq.error")}).drop("_pq")

    def search_many(self, encoded: DataFrame, vector: str, queries: DataFrame, k: int, key: str, oversample: int = 8, to: str = "pq") -> DataFrame:
        """For each of queries (query_id, each once, and query) the k nearest rows by L2, with query_id and `distance`."""
        books = self.codebooks

        def method(ask: _Queries, x: np.ndarray, rows: pa.StructArray) -> Iterator[Piece]:
            q, q2 = ask.q, ask.q2
            codes, error = np.asarray(rows.field(to).flatten()).reshape(len(rows), len(books)), np.asarray(rows.field(f"{to}_error"))
            # the tables' sums, as one product with what the codes stand for
            said = books[np.arange(len(books)), codes].reshape(len(rows), -1)
            far = (said**2).sum(1)
            estimate = (-2 * q) @ said.T
            estimate += far

            def may(reach: np.ndarray) -> np.ndarray:
                r = reach + 1e-6 * (np.sqrt(far.max()) + np.sqrt(q2))
                least = np.hstack([-2 * q, -2 * r[:, None]]) @ np.hstack([said, error[:, None]]).T  # sqrt(sum) <= r + error, squared
                least += far - error**2
                return ~(least > (r**2 - q2)[:, None])

            yield np.arange(len(q)), slice(0, len(x)), estimate, may

        queries = queries.where(F.size("query") == books.shape[0] * books.shape[2])
        return _search(encoded, vector, queries, k, key, oversample, method).drop(f"{to}_error")

    def search(self, encoded: DataFrame, vector: str, query: Sequence[float], k: int, key: str, oversample: int = 8, to: str = "pq") -> DataFrame:
        return self.search_many(encoded, vector, one_query(encoded, query), k, key, oversample, to).drop("query_id").orderBy("distance", key)


def scalar_quantized(df: DataFrame, vector: str, levels: int = 255, to: str = "codes") -> tuple[DataFrame, float, float]:
    """Each component as a whole number of 0..levels between the least and the greatest of all; and those two."""
    low, high = df.agg(F.min(F.array_min(vector)), F.max(F.array_max(vector))).first()
    low, high = float(low or 0), float(high or 0)
    step = (high - low) / levels or 1.0
    return df.withColumn(to, F.transform(vector, lambda x: F.round((x.cast("double") - low) / step).cast("int"))), low, step


def dequantized(codes: Column, low: float, step: float) -> Column:
    return F.transform(codes, lambda c: c * F.lit(step) + low)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embed(text: str | None, dim: int) -> list[float]:
    """Each word adds 1 or -1, by its hash's top bit, at its hash modulo dim; then unit length."""
    v = [0.0] * dim
    for word in (text or "").split():
        h = fnv1a(word.lower().encode())
        v[h % dim] += -1.0 if h >> 63 else 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embedded(df: DataFrame, text: str, dim: int, to: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hash_embed(t, dim))

    return df.withColumn(to, embed(F.col(text)))


def mlp(df: DataFrame, vector: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, to: str = "scores") -> DataFrame:
    """A two-layer network (ReLU, softmax) over a vector column, a matrix product a batch."""

    @F.pandas_udf("array<double>")
    def infer(v: pd.Series) -> pd.Series:
        x = np.maximum(np.array(v.tolist(), np.float64) @ w1 + b1, 0) @ w2 + b2
        e = np.exp(x - x.max(1, keepdims=True))
        return pd.Series(list(e / e.sum(1, keepdims=True)))

    return df.withColumn(to, infer(F.col(vector)))
