"""The registered queries of the engine: one per operator, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import geo, graph, hybrid, relational, stats, text, timeseries, vector
from .plans.compiler import Options
from .session import Engine

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}
OUT: dict[str, Query] = {}
SQL: dict[str, str] = {}


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def engine(spark: SparkSession, d: str, *tables: str) -> Engine:
    """Every row counts here: no implicit limit; NaN by Spark's rules, so that filters reach the scan."""
    e = Engine(spark, Options(implicit_limit=None, nan_less=False))
    for t in tables:
        e.register(t, load(spark, d, t), KEYS.get(t), vector="embedding" if t == "embeddings" else None, doc="props" if t == "events" else None)
    return e


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def said(name: str, tables: str, query: str, sql: str | None = None, **places: int) -> None:
    """A query in the dialect; sql is the same text but for what places round."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(engine(spark, d, *tables.split()).query(query), **places)

    OUT[name] = run
    SQL[name] = sql or query


def made(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        OUT[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- scans, filters, expressions

said("scan", "orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
said("filter", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR NOT l_discount < 0.05)")
said("point_lookup", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
said("case_if", "orders", "SELECT o_orderkey, IF o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
said("case_searched", "part", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS name FROM part")
said("in_list", "part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11')")
said("between", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_retailprice NOT BETWEEN 1000 AND 1200")
said("like", "part", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_a%'")
said("ilike", "part", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%n%'")
said("coalesce", "lineitem", "SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_returnflag, 'N'), 'none') AS flag FROM lineitem")
said("nullif", "part", "SELECT p_partkey, NULLIF(p_size, 7) AS size FROM part")
said("is_null", "part", "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) IS NULL")
said("is_true", "orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND o_custkey IS NOT NULL")
said("distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
said("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5")
said("order_nulls", "part", "SELECT DISTINCT NULLIF(p_size, 7) AS size FROM part")
said("arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")

# -- aggregates

said("group_by", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc, MIN(l_tax) AS lo, MAX(l_extendedprice) AS hi FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS sum_qty, round(AVG(l_discount), 6) AS avg_disc, MIN(l_tax) AS lo, MAX(l_extendedprice) AS hi FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus", sum_qty=2, avg_disc=6)
said("having_hidden_agg", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 300000 AND COUNT(*) > 3")
said("agg_case", "orders", "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders GROUP BY o_orderpriority")
said("global_agg_empty", "orders", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
said("count_column", "part", "SELECT p_brand, COUNT(NULLIF(p_size, 7)) AS n FROM part GROUP BY p_brand")

# -- joins

_J = "SELECT customer.c_custkey AS c, nation.n_name AS n FROM customer {} JOIN nation ON customer.c_nationkey = nation.n_nationkey"
said("join_inner", "customer nation", _J.format("INNER"))
said("join_left", "customer orders", "SELECT customer.c_custkey AS c, orders.o_orderkey AS o FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey")
said("join_right", "orders customer", "SELECT orders.o_orderkey AS o, customer.c_custkey AS c FROM orders RIGHT JOIN customer ON orders.o_custkey = customer.c_custkey")
said("join_full", "supplier nation", "SELECT supplier.s_suppkey AS s, nation.n_nationkey AS n FROM supplier FULL JOIN nation ON supplier.s_nationkey = nation.n_nationkey")
said("join_cross", "nation region", "SELECT nation.n_name AS n, region.r_name AS r FROM nation CROSS JOIN region")
said("join_filter", "orders customer", "SELECT orders.o_orderkey AS o, customer.c_mktsegment AS m FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_totalprice > 200000 AND customer.c_acctbal < 1000")
said("join_group", "orders customer", "SELECT customer.c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment", 'SELECT customer.c_mktsegment AS "customer.c_mktsegment", COUNT(*) AS n FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment')

# -- subqueries, CTEs, sets

said("in_subquery", "orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
said("not_in_subquery", "orders customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
said("not_in_null", "part supplier", "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT NULLIF(s_nationkey, 3) AS k FROM supplier)")
said("scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) AS m FROM orders)")
said("exists", "orders", "SELECT COUNT(*) AS n FROM orders WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice > 0) AND NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice < 0)")
said("derived", "orders", "SELECT s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s, o_custkey FROM orders WHERE o_totalprice > 1000) AS d GROUP BY s")
said("cte", "orders customer", "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 250000), who AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)) SELECT COUNT(*) AS n FROM who")
_SETS = {"union_all": "UNION ALL", "union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT"}
for _name, _op in _SETS.items():
    said(_name, "supplier customer", f"SELECT s_nationkey AS k FROM supplier {_op} SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000")
said("intersect_all_filter", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s_acctbal > 5000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
said("except_all_filter", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s_acctbal > 5000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")


@made("bag_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
def bag_intersect(spark: SparkSession, d: str) -> DataFrame:
    return relational.bag_operation("intersect", load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@made("bag_except", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
def bag_except(spark: SparkSession, d: str) -> DataFrame:
    return relational.bag_operation("except", load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@made("recursive_distinct", "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 2 + 1) % 25 FROM r) SELECT k FROM r")
def recursive_distinct(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "nation").where("n_nationkey = 1").select(F.col("n_nationkey").alias("k"))
    return relational.fixed_point(base, lambda delta: delta.select(((F.col("k") * 2 + 1) % 25).alias("k")))


@made("recursive_all", "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT k + 3 FROM r WHERE k < 20) SELECT k FROM r")
def recursive_all(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("k"))
    return relational.fixed_point(base, lambda delta: delta.where("k < 20").select((F.col("k") + 3).alias("k")), distinct=False)


said("recursive_dialect", "nation", "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 3 UNION SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT k FROM r)) SELECT k FROM r")

# -- windows

_W = "(PARTITION BY o_custkey ORDER BY o_orderkey{})"
_FULL = " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
for _f in ("row_number()", "rank()", "dense_rank()", "lag(o_orderstatus)", "lead(o_orderkey, 2)"):
    said("win_" + _f.split("(")[0], "orders", f"SELECT o_orderkey, {_f} OVER {_W.format('')} AS w FROM orders")
for _f in ("first_value(o_orderstatus)", "last_value(o_orderstatus)", "nth_value(o_orderkey, 2)", "min(o_orderstatus)", "max(o_orderkey)", "count(o_orderkey)"):
    said("win_" + _f.split("(")[0], "orders", f"SELECT o_orderkey, {_f} OVER {_W.format('')} AS w FROM orders", f"SELECT o_orderkey, {_f} OVER {_W.format(_FULL)} AS w FROM orders")
said("win_ntile", "orders", f"SELECT o_orderkey, ntile(3) OVER {_W.format('')} AS w FROM orders", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 3 / count(*) OVER (PARTITION BY o_custkey)) + 1 AS BIGINT) AS w FROM orders")
said("win_sum_full", "orders", f"SELECT o_orderkey, sum(o_custkey) OVER {_W.format('')} AS w FROM orders", f"SELECT o_orderkey, CAST(sum(o_custkey) OVER {_W.format(_FULL)} AS BIGINT) AS w FROM orders")
said("win_rows_frame", "orders", f"SELECT o_orderkey, sum(o_orderkey) OVER {_W.format(' ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING')} AS w FROM orders", f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER {_W.format(' ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING')} AS BIGINT) AS w FROM orders")
said("win_rows_clamped", "orders", f"SELECT o_orderkey, sum(o_orderkey) OVER {_W.format(' ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING')} AS w FROM orders", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT a.o_orderkey, CAST(sum(b.o_orderkey) AS BIGINT) AS w FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND b.i BETWEEN greatest(1, a.i - 3) AND greatest(1, a.i - 1) GROUP BY a.o_orderkey")
said("win_avg", "orders", "SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS w FROM orders", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS w FROM orders", w=6)

# -- time series


def points(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", "user_id", timeseries.millis(F.col("ts")).alias("t"), F.col("value").alias("v"))


_T = "SELECT *, epoch_us(ts) // 1000 AS t, value AS v FROM events"
_H = 3_600_000


@made("ts_bucket", f"SELECT (t // {_H}) * {_H} AS bucket_start, (t // {_H}) * {_H} + {_H} AS bucket_end, round(avg(v), 6) AS value FROM ({_T}) GROUP BY 1, 2")
def ts_bucket(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeseries.bucketed(points(spark, d), "t", _H, "v", "avg"), value=6)


@made("ts_window", f"WITH p AS ({_T}), f AS (SELECT min(t) AS t0, max(t) AS t1 FROM p), w AS (SELECT t0 + s * {12 * _H} AS window_start FROM f, generate_series(0, CAST((t1 - t0) // {12 * _H} AS BIGINT)) g(s)) SELECT window_start, round(sum(v), 4) AS value FROM w JOIN p ON t >= window_start AND t < window_start + {24 * _H} GROUP BY 1")
def ts_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeseries.windows(points(spark, d), "t", "v", 24 * _H, 12 * _H, "sum"), value=4)


_GRID = (1_704_067_200_000, 1_704_067_200_000 + 48 * _H, 6 * _H)


@made("ts_resample", f"WITH p AS (SELECT user_id, t, max(v) AS v FROM ({_T}) GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM p), g AS (SELECT unnest(generate_series({_GRID[0]}, {_GRID[1] - 1}, {_GRID[2]})) AS ts) SELECT u.user_id, g.ts, (SELECT arg_max(p.v, p.t) FROM p WHERE p.user_id = u.user_id AND p.t <= g.ts) AS value FROM u, g")
def ts_resample(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.resampled(points(spark, d), "t", "v", *_GRID, by=("user_id",))


@made("ts_resample_all", f"WITH p AS (SELECT user_id, t, max(v) AS v FROM ({_T}) WHERE t IS NOT NULL GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT min(t) // {_GRID[2]} AS a, max(t) // {_GRID[2]} + 1 AS b FROM p), g AS (SELECT unnest(generate_series(a, b)) * {_GRID[2]} AS ts FROM f WHERE a IS NOT NULL) SELECT u.user_id, g.ts, arg_max(p.v, p.t) AS value FROM u CROSS JOIN g LEFT JOIN p ON p.user_id = u.user_id AND p.t <= g.ts GROUP BY 1, 2")
def ts_resample_all(spark: SparkSession, d: str) -> DataFrame:
    """ts_resample keeps the two days of its SQL; this grid goes from the place at or before the first event to the one
    after the last, so every event is on it."""
    p, step = points(spark, d), _GRID[2]
    first, last = p.agg(F.min("t"), F.max("t")).first()
    start, end = (0, 0) if first is None else (first // step * step, last // step * step + 2 * step)
    return timeseries.resampled(p, "t", "v", start, end, step, by=("user_id",))


@made("ts_rate", f"WITH l AS (SELECT user_id, t, v, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM ({_T}) WINDOW w AS (PARTITION BY user_id ORDER BY t, v)) SELECT user_id, t AS ts, round((v - v0) / ((t - t0) / 1000.0), 6) AS rate FROM l WHERE t > t0")
def ts_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeseries.rate(points(spark, d), "t", "v", ("user_id",)), rate=6)


@made("ts_moving_avg", f"WITH l AS (SELECT user_id, t AS ts, avg(v) OVER (PARTITION BY user_id ORDER BY t, v ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS average, row_number() OVER (PARTITION BY user_id ORDER BY t, v) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ({_T})) SELECT user_id, ts, round(average, 6) AS average FROM l WHERE k >= least(5, n)")
def ts_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeseries.moving_average(points(spark, d), "t", "v", 5, ("user_id",)), average=6)


@made("ts_percentile", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def ts_percentile(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("user_id").agg(F.round(timeseries.percentile(F.col("v"), 90), 6).alias("p90"))


@made("ts_downsample", f"WITH l AS (SELECT user_id, t, v, (row_number() OVER (PARTITION BY user_id ORDER BY t, v) - 1) // 10 AS c FROM ({_T})) SELECT user_id, CAST(floor(sum(t) / count(*)) AS BIGINT) AS ts, max(v) AS value FROM l GROUP BY user_id, c")
def ts_downsample(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.downsampled(points(spark, d), "t", "v", 10, "max", ("user_id",))


@made("ts_retention", f"SELECT event_id, t FROM ({_T}) WHERE t >= {_GRID[0]} + {20 * 24 * _H} - {5 * 24 * _H}")
def ts_retention(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.retained(points(spark, d), "t", _GRID[0] + 20 * 24 * _H, 5 * 24 * _H).select("event_id", "t")


@made("ts_continuous", f"SELECT (t // {24 * _H}) * {24 * _H} AS bucket_start, count(v) AS n, round(sum(v), 4) AS total, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean FROM ({_T}) GROUP BY 1")
def ts_continuous(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    parts = [timeseries.partials(p.where(F.col("event_id") % 2 == k), "t", "v", 24 * _H) for k in (0, 1)]
    return rounded(timeseries.read_aggregate(timeseries.merged(*parts)), total=4, mean=6)


# -- vectors

_Q = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_QS = "[" + ", ".join(map(str, _Q)) + "]"
for _m, _d in (("l2", "list_distance(e, q)"), ("cosine", "list_cosine_distance(e, q)"), ("ip", "-list_inner_product(e, q)")):

    def _knn(spark: SparkSession, d: str, m: str = _m) -> DataFrame:
        out = vector.knn(load(spark, d, "embeddings"), "embedding", _Q, 10, m, "vec_id")
        return out.select("vec_id", F.round("distance", 4).alias("distance"))

    OUT[f"knn_{_m}"] = _knn
    SQL[f"knn_{_m}"] = f"SELECT vec_id, round({_d}, 4) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {_QS}::DOUBLE[] AS q FROM embeddings) ORDER BY {_d}, vec_id LIMIT 10"
said("knn_filtered", "embeddings", f"SELECT vec_id FROM embeddings WHERE label < 3 KNN embedding <|7|> {_QS}", f"SELECT vec_id FROM embeddings WHERE label < 3 ORDER BY list_distance(embedding::DOUBLE[], {_QS}::DOUBLE[]), vec_id LIMIT 7")


def asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@made("knn_quantized")
def knn_quantized(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return vector.knn_quantized_many(e, "embedding", asked(e), 10, "vec_id").select("query_id", "vec_id", "distance")


@made("knn_ivf")
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector.Ivf.fit(e, "embedding", 16)
    return index.search_many(index.assign(e, "embedding"), "embedding", asked(e), 10, 8, "vec_id").select("query_id", "vec_id", "list_id", "distance")


@made("knn_pq")
def knn_pq(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    pq = vector.ProductQuantizer.fit(e, "embedding", 16)
    return pq.search_many(pq.encode(e, "embedding"), "embedding", asked(e), 10, "vec_id").select("query_id", "vec_id", "distance")


@made("vector_normalize", "SELECT vec_id, round(sqrt(list_inner_product(e, e)), 4) AS norm, 1.0::DOUBLE AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").withColumn("u", vector.normalize(F.col("embedding")))
    return e.select("vec_id", F.round(vector.norm(F.col("embedding")), 4).alias("norm"), F.round(vector.norm(F.col("u")), 6).alias("unit"))


@made("scalar_quantize")
def scalar_quantize(spark: SparkSession, d: str) -> DataFrame:
    return vector.scalar_quantized(load(spark, d, "embeddings"), "embedding")[0].select("vec_id", "codes")


@made("hash_embed")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return vector.embedded(load(spark, d, "documents").select("doc_id", "text"), "text", 32).select("doc_id", "embedding")


# -- full text

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_BM = """WITH d AS (SELECT doc_id, TOK AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
q AS (SELECT unnest(['the', 'and', 'idiot']) AS t), f AS (SELECT t, count(*) AS df FROM q JOIN d ON list_contains(w, t) GROUP BY t)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / m))), 6) AS score
FROM (SELECT doc_id, w, t, df, len(list_filter(w, lambda x: x = t)) AS tf FROM d, f) x, s WHERE tf > 0 GROUP BY doc_id""".replace("TOK", _TOK)


@made("bm25", _BM)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.bm25(load(spark, d, "documents"), "text", "the and idiot", "doc_id"), score=6)


said("match_topk", "documents", "SELECT doc_id FROM documents WHERE MATCH(text, 'the and idiot') LIMIT 15", f"SELECT doc_id FROM ({_BM}) ORDER BY score DESC, doc_id LIMIT 15")


@made("prefix_search", "WITH d AS (SELECT doc_id, TOK AS w FROM documents) SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'idio'))) > 0".replace("TOK", _TOK))
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return text.bm25(load(spark, d, "documents"), "text", "idio", "doc_id", prefix=True).select("doc_id")


@made("fuzzy", "SELECT n_name, levenshtein(lower(n_name), 'germany') AS distance, round(1 - levenshtein(lower(n_name), 'germany') / greatest(strlen(n_name), 7), 6) AS similarity FROM nation")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    n = F.lower("n_name")
    return load(spark, d, "nation").select("n_name", F.levenshtein(n, F.lit("germany")).cast("long").alias("distance"), F.round(text.similarity(n, F.lit("germany")), 6).alias("similarity"))


@made("phrase", "SELECT doc_id FROM documents WHERE regexp_matches(' ' || lower(text) || ' ', '\\sthe\\s(.*\\s)?of\\s(.*\\s)?and\\s', 's')")
def phrase(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(text.phrase(F.col("text"), "the of and")).select("doc_id")


@made("proximity", "WITH d AS (SELECT doc_id, TOK AS w FROM documents) SELECT doc_id FROM d WHERE list_position(w, 'the') > 0 AND list_position(w, 'and') - list_position(w, 'the') BETWEEN 1 AND 6".replace("TOK", _TOK))
def proximity(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(text.proximity(F.col("text"), "the and", 5)).select("doc_id")


@made("stemming")
def stemming(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").count()
    return words.select("word", "count", text.naive_stem(F.col("word")).alias("naive"), text.porter(F.col("word")).alias("porter"))


@made("hybrid_rrf")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = load(spark, d, "documents").select("doc_id", "text").join(e, "doc_id", "left")
    return hybrid.search(docs, "doc_id", 10, "the and idiot", "text", _Q, "embedding")


@made("hybrid_maxsim")
def hybrid_maxsim(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return hybrid.rescored(hybrid.search(docs, "doc_id", 10, "the and idiot", "text"), docs, "doc_id", "text", "the and idiot")


# -- documents

said("doc_extract", "events", "SELECT event_id, props FROM events WHERE props -> 'k' > 50", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
OUT["doc_extract"] = lambda spark, d: engine(spark, d, "events").query("SELECT event_id FROM events WHERE props -> 'k' > 50")
OUT["doc_contains"] = lambda spark, d: engine(spark, d, "events").query("SELECT event_id FROM events WHERE props @> '{\"k\": 7}'")
SQL["doc_contains"] = "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 7"

# -- graphs


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought together with suppliers: part number to supplier number beyond all parts."""
    li = load(spark, d, "lineitem").where("l_orderkey % 40 = 0 or l_quantity > 49")
    return li.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))


_E = "SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst FROM lineitem WHERE l_orderkey % 40 = 0 OR l_quantity > 49"


@made("neighbors", f"SELECT src, dst FROM ({_E}) UNION SELECT dst, src FROM ({_E})")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d), "both")


@made("bfs_depth", f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_E}) UNION SELECT dst, src FROM ({_E})), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.bfs(edges(spark, d), seeds, 3, direction="both")


_COMMON = "SELECT DISTINCT o_custkey AS src, -1 - (o_orderkey % 500) AS dst FROM orders WHERE o_totalprice > 300000"


@made("connected_components", f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_COMMON}) UNION SELECT dst, src FROM ({_COMMON})), r AS (SELECT src AS node, src AS c FROM e UNION SELECT e.dst, r.c FROM r JOIN e ON r.node = e.src WHERE r.c < e.dst) SELECT node, min(c) AS component FROM (SELECT * FROM r UNION ALL SELECT src, src FROM e) GROUP BY node")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_totalprice > 300000")
    return graph.connected_components(o.select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey") % 500).alias("dst")))


_PR = ["WITH e AS MATERIALIZED (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 30 AS dst FROM nation), v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS MATERIALIZED (SELECT count(*) AS n FROM v), g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM v, n)"]
for _i in range(1, 11):
    _p = f"r{_i - 1}"
    _PR.append(f"r{_i} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / n + 0.85 * (coalesce((SELECT sum(x.r / g.deg) FROM e JOIN {_p} x ON e.src = x.node JOIN g ON g.src = e.src WHERE e.dst = v.node), 0) + (SELECT coalesce(sum(r), 0) FROM {_p} WHERE node NOT IN (SELECT src FROM e)) / n) AS r FROM v, n)")


@made("pagerank_fixed_iters", ", ".join(_PR) + " SELECT node, round(r / (SELECT sum(r) FROM r10), 8) AS rank FROM r10")
def pagerank_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 30).alias("dst"))
    return rounded(graph.pagerank(n, iterations=10), rank=8)


# The four above keep the rows that their SQL keeps; these take the whole tables.


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the suppliers that they were ever bought from: part number to -1 - supplier number."""
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))


_ALL = "SELECT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem"


@made("neighbors_all", f"SELECT src, dst FROM ({_ALL}) UNION SELECT dst, src FROM ({_ALL})")
def neighbors_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(all_edges(spark, d), "both")


@made("bfs_depth_all")
def bfs_depth_all(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.bfs(all_edges(spark, d), seeds, 3, direction="both")


@made("connected_components_all")
def connected_components_all(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return graph.connected_components(o.select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey") % 500).alias("dst")))


@made("pagerank_all")
def pagerank_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.pagerank(graph.neighbors(all_edges(spark, d), "both"), iterations=10, distinct=True), rank=8)


@made("path", "SELECT c_custkey, CASE WHEN n IS NULL THEN NULL ELSE n END AS nation, r AS region FROM (SELECT c_custkey, CAST(n_nationkey AS VARCHAR) AS n, CAST(n_regionkey AS VARCHAR) AS r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)")
def path(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "customer", "nation", "region")
    row = lambda t, s, label, u, k: t.select(F.lit(s[0]).alias("src_table"), F.col(s[1]).cast("string").alias("src"), F.lit(label).alias("label"), F.lit(u).alias("dst_table"), F.col(k).cast("string").alias("dst"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("long").alias("ts_unix"))
    c = row(load(spark, d, "customer"), ("customer", "c_custkey"), "lives", "nation", "c_nationkey")
    e.set_edges(c.union(row(load(spark, d, "nation"), ("nation", "n_nationkey"), "lies", "region", "n_regionkey")))
    return e.query("SELECT c_custkey, ->lives->nation AS nation, ->lives->nation->lies->region AS region FROM customer")


# -- geography

_LON, _LAT = "(c_custkey * 7 % 360) - 180.0", "(c_custkey * 13 % 180) - 90.0"
_G = f"SELECT c_custkey, CAST({_LON} AS DOUBLE) AS lon, CAST({_LAT} AS DOUBLE) AS lat FROM customer"


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", (k * 7 % 360 - 180.0).alias("lon"), (k * 13 % 180 - 90.0).alias("lat"))


@made("haversine", f"SELECT c_custkey, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(lat)) * pow(sin(radians(lon - 11.0) / 2), 2)))), 3) AS m FROM ({_G})")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("c_custkey", F.round(geo.haversine(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon")), 3).alias("m"))


@made("rect_contains", f"SELECT c_custkey FROM ({_G}) WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 60")
def rect_contains(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).where(geo.in_rect(F.col("lon"), F.col("lat"), (-20, 30, 40, 60))).select("c_custkey")


@made("planar", f"SELECT c_custkey, round(sqrt(lon * lon + lat * lat), 6) AS e, abs(lon) + abs(lat) AS m FROM ({_G})")
def planar(spark: SparkSession, d: str) -> DataFrame:
    x, y, o = F.col("lon"), F.col("lat"), F.lit(0.0)
    return places(spark, d).select("c_custkey", F.round(geo.euclidean(x, y, o, o), 6).alias("e"), geo.manhattan(x, y, o, o).alias("m"))


@made("geo_knn", f"SELECT c_custkey FROM ({_G}) ORDER BY sqrt(pow(lon - 10, 2) + pow(lat - 50, 2)), c_custkey LIMIT 12")
def geo_knn(spark: SparkSession, d: str) -> DataFrame:
    return geo.nearest(places(spark, d), "lon", "lat", (10.0, 50.0), 12, "c_custkey").select("c_custkey")


@made("geohash")
def geohash(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    return p.select("c_custkey", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("hash"), geo.hilbert(F.col("lon") + 180, F.col("lat") + 90, 9).alias("hilbert"))


# -- changes, versions, views, statistics

_O = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def small_engine(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark, Options(implicit_limit=None, nan_less=False))
    e.register("orders", load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return e


@made("update", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def update(spark: SparkSession, d: str) -> DataFrame:
    e = small_engine(spark, d)
    e.query("UPDATE orders SET o_orderstatus = 'X' WHERE o_totalprice > 100000")
    return e.query("SELECT * FROM orders")


@made("delete", f"{_O} WHERE NOT o_totalprice > 100000")
def delete(spark: SparkSession, d: str) -> DataFrame:
    e = small_engine(spark, d)
    e.query("DELETE FROM orders WHERE o_totalprice > 100000")
    return e.query("SELECT * FROM orders")


@made("upsert", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey = 1 THEN 5.0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1, 'N', 7.0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    e = small_engine(spark, d)
    e.query("INSERT INTO orders (o_orderkey, o_orderstatus, o_totalprice) VALUES (1, 'Z', 5), (-1, 'N', 7.0) ON CONFLICT (o_orderkey) DO UPDATE SET o_totalprice = excluded.o_totalprice")
    return e.query("SELECT * FROM orders")


@made("time_travel", "SELECT 'before' AS at, count(*) AS n FROM orders UNION ALL SELECT 'after', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    e = small_engine(spark, d)
    tx = e.tx
    e.query("DELETE FROM orders WHERE o_orderstatus = 'F'")
    count = "SELECT COUNT(*) AS n FROM orders"
    return e.query_at(count, tx).select(F.lit("before").alias("at"), "n").union(e.query(count).select(F.lit("after"), "n"))


@made("mv_delta", "SELECT count(*) FILTER (o_totalprice > 250000 AND o_orderstatus <> 'P') AS unchanged, count(*) FILTER (o_totalprice > 250000 AND o_orderstatus = 'P') AS deleted, 0::BIGINT AS inserted FROM orders")
def mv_delta(spark: SparkSession, d: str) -> DataFrame:
    e = small_engine(spark, d)
    e.create_view("big", "SELECT * FROM orders WHERE o_totalprice > 250000")
    e.query("DELETE FROM orders WHERE o_orderstatus = 'P'")
    r = e.refresh_view("big")
    return spark.createDataFrame([(r["unchanged"], r["deleted"], r["inserted"])], "unchanged long, deleted long, inserted long")


@made("analyze", "SELECT 'o_orderstatus' AS \"column\", count(*) AS \"rows\", count(*) - count(o_orderstatus) AS nulls, count(DISTINCT o_orderstatus) AS \"distinct\", min(o_orderstatus) AS \"min\", max(o_orderstatus) AS \"max\" FROM orders UNION ALL SELECT 'o_custkey', count(*), 0, count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders")
def analyze(spark: SparkSession, d: str) -> DataFrame:
    return stats.analyzed(load(spark, d, "orders").select("o_orderstatus", "o_custkey")).drop("histogram")


@made("prepared", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def prepared(spark: SparkSession, d: str) -> DataFrame:
    return small_engine(spark, d).prepare("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ("text", "float")).run("O", 200_000)


@made("script", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000")
def script(spark: SparkSession, d: str) -> DataFrame:
    return small_engine(spark, d).script("LET $least = 150000; SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > $least")



def queries() -> dict[str, Query]:
    return dict(OUT)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
