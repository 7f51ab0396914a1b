from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold import queries
from manyfold.functions import codecs
from manyfold.operators import geo, graph, hybrid, relational, stats, text, timeseries, vector
from manyfold.sources.blobs import BlobStore, media_type
from manyfold.sources.columnar import ColumnarTable
from manyfold.streaming.continuous import continuous


@pytest.mark.parametrize("values", [[], [1.5], [1.5, 1.5, 2.25, -0.0, 0.0, 1e300, 5e-324], [round(20.1 + i / 10, 1) for i in range(200)], [math.pi * i for i in range(50)]])
def test_codecs(values):
    for enc, dec in ((codecs.xor_encode, codecs.xor_decode), (codecs.decimal_encode, codecs.decimal_decode)):
        got = dec(enc(values))
        assert [x.hex() for x in got] == [float(x).hex() for x in values]
    assert math.isnan(codecs.decimal_decode(codecs.decimal_encode([math.nan]))[0]) and math.isnan(codecs.xor_decode(codecs.xor_encode([1.0, math.nan]))[1])
    if len(values) == 200:
        assert len(codecs.decimal_encode(values)) < 1600 / 3


def test_time_series(spark):
    df = spark.createDataFrame([(i * 1000, float(i)) for i in range(30)] + [(-1, 5.0)], "t long, v double")
    assert df.where("t < 0").select(timeseries.time_bucket(F.col("t"), 1000)).first()[0] == -1000
    got = {r["bucket_start"]: r["value"] for r in timeseries.bucketed(df.where("t >= 0"), "t", 10_000, "v", "sum").collect()}
    assert got == {0: 45.0, 10_000: 145.0, 20_000: 245.0}
    w = {r["window_start"]: r["value"] for r in timeseries.windows(df, "t", "v", 2000, 1000, "count").collect()}
    assert w[-1] == 3 and all(v > 0 for v in w.values()) and max(w) == 28_999 and w[28_999] == 1
    few = spark.createDataFrame([(5, 1.0), (25, 2.0), (25, 3.0), (31, 9.0)], "t long, v double")
    assert [tuple(r) for r in timeseries.resampled(few, "t", "v", 0, 50, 10).orderBy("ts").collect()] == [(0, None), (10, 1.0), (20, 1.0), (30, 3.0), (40, 9.0)]
    assert [r[1] for r in timeseries.resampled(few, "t", "v", 5, 45, 10, "null").orderBy("ts").collect()] == [1.0, None, 3.0, None]
    assert [tuple(r) for r in timeseries.rate(few, "t", "v").orderBy("ts").collect()] == [(25, 50.0), (31, 1000.0)]
    assert [r[1] for r in timeseries.moving_average(few, "t", "v", 9).collect()] == [3.75]
    assert sorted(tuple(r) for r in timeseries.downsampled(few, "t", "v", 3).collect()) == [(18, 2.0), (31, 9.0)]
    assert few.agg(timeseries.percentile(F.col("v"), 25)).first()[0] == 1.75
    for wrong in (lambda: timeseries.time_bucket(F.col("t"), 0), lambda: timeseries.windows(few, "t", "v", 5, 6), lambda: timeseries.percentile(F.col("v"), 101)):
        with pytest.raises(ValueError, match="."):
            wrong()


def test_resampled_grid_covers_all_events(spark):
    d, step = "/root/testdata/sf0.001", 6 * 3_600_000
    rows = [(r["user_id"], r["t"], r["v"]) for r in queries.points(spark, d).collect()]
    got = {(r["user_id"], r["ts"]): r["value"] for r in queries.queries()["ts_resample_all"](spark, d).collect()}
    first, last = min(t for _, t, _ in rows), max(t for _, t, _ in rows)
    places, users = {ts for _, ts in got}, {u for u, _, _ in rows}
    assert min(places) <= first < min(places) + step and max(places) - step <= last < max(places)
    assert len(got) == len(users) * len(places) and len(places) == (max(places) - min(places)) // step + 1
    for u in users:
        assert got[u, max(places)] == max((t, v) for w, t, v in rows if w == u)[1]


def test_stream(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") * 1000).alias("ms"), F.col("id").cast("double").alias("v")).select(F.timestamp_millis("ms").alias("ts"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = continuous(points, "ts", "v", 10_000).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["bucket_start"], r["n"], r["mean"]) for r in spark.table("buckets").collect()) == [(0, 10, 4.5), (10_000, 10, 14.5), (20_000, 10, 24.5), (30_000, 10, 34.5)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0])], "id long, e array<double>")
    assert [r["id"] for r in vector.knn(df, "e", [3.0, 3.0], 5, key="id").collect()] == [2, 1]
    cos = {r["id"]: r["d"] for r in df.where("size(e) = 2").select("id", vector.distance(F.col("e"), [3.0, 4.0], "cosine").alias("d")).collect()}
    assert cos[1] == 1.0 and cos[2] == pytest.approx(0)
    got, low, step = vector.scalar_quantized(df.where("size(e) = 2"), "e")
    assert [list(r[0]) for r in got.orderBy("id").select(vector.dequantized(F.col("codes"), low, step)).collect()][1] == pytest.approx([3.0, 4.0], abs=0.02)
    v = vector.hash_embed("a b A", 8)
    assert sum(x * x for x in v) == pytest.approx(1) and vector.hash_embed("", 4) == [0.0] * 4
    out = vector.mlp(df.where("size(e) = 2"), "e", np.eye(2), np.zeros(2), np.eye(2), np.zeros(2)).orderBy("id").collect()
    assert list(out[0]["scores"]) == pytest.approx([0.5, 0.5]) and sum(out[1]["scores"]) == pytest.approx(1)


def test_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    pq = vector.ProductQuantizer.fit(e, "embedding", 16)
    enc = pq.encode(e, "embedding").cache()
    index = vector.Ivf.fit(e, "embedding", 8)
    lists = index.assign(e, "embedding").cache()
    hits = [0, 0]
    for q in [list(r[0]) for r in e.where("vec_id % 100 = 0").select("embedding").collect()]:
        want = {r["vec_id"] for r in vector.knn(e, "embedding", q, 10, key="vec_id").collect()}
        hits[0] += len(want & {r["vec_id"] for r in pq.search(enc, "embedding", q, 10, "vec_id").collect()})
        hits[1] += len(want & {r["vec_id"] for r in index.search(lists, "embedding", q, 10, 6, "vec_id").collect()})
    assert min(hits) >= 0.9 * 50


@pytest.mark.parametrize("name", ["knn_quantized", "knn_pq", "knn_ivf"])
def test_registered_recall(spark, name):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in queries.queries()[name](spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and len(got) == 100
    for i, q in zip(ids, x):
        if i % 20 == 0:
            assert got[i] == set(ids[np.lexsort((ids, ((x - q) ** 2).sum(1)))[:10]]), i


def test_index_measures_all_where_few_are_near(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)] + [(9, [1.0]), (10, None)], "id long, e array<double>")
    assert [r["id"] for r in vector.knn_quantized(df, "e", [0.0, 0.0], 9, "id", 1).collect()] == [0, 1, 2, 3, 4, 5]
    index = vector.Ivf(np.array([[0.0, 0.0], [5.0, 0.0]]))
    assert [r["id"] for r in index.search(index.assign(df, "e"), "e", [2.4, 0.0], 4, 1, "id").collect()] == [2, 3, 1, 4]


@pytest.mark.parametrize("method", ["ivf", "pq", "quantized"])
def test_search_in_blocks(spark, monkeypatch, method):
    """Many blocks, sizes that differ, keys that are text, copies, ties, a null component: as by brute force; and pairs of rows are no rows of the plan."""
    monkeypatch.setattr(vector, "ROWS", 64)
    monkeypatch.setattr(vector, "QUERIES", 32)
    monkeypatch.setattr(vector, "SORTED", 50)
    r = random.Random(5)
    rows = [(f"k{i:03}", [float(r.randint(-2, 2)) for _ in range(4)], i) for i in range(150)] + [(f"c{i}", [1.0, 1.0, 1.0, 1.0], i) for i in range(30)] + [("n", [1.0, None, 1.0, 1.0], 0)]
    rest = [("short", [1.0], 0), ("none", None, 0)]
    asks = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(40)] + [(98, [1.0, 1.0, 1.0, 1.0])]
    df, small = (spark.createDataFrame(x, "id string, e array<float>, n int") for x in (rows + rest, rows[:180]))
    queries = spark.createDataFrame([*asks, (99, None)], "query_id long, query array<double>")
    if method == "ivf":
        index = vector.Ivf.fit(small, "e", 3)
        out = index.search_many(index.assign(df.where("id != 'n'"), "e"), "e", queries, 7, 1, "id")
    elif method == "pq":
        pq = vector.ProductQuantizer.fit(small, "e", 2, 4)
        out = pq.search_many(pq.encode(small, "e"), "e", queries, 7, "id", 1)
    else:
        out = vector.knn_quantized_many(df, "e", queries, 7, "id", 1)
    assert {"id", "e", "n", "query_id", "distance"} <= set(out.columns)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow") < plan.index("Join Cross")
    got = {}
    for x in out.collect():
        got.setdefault(x["query_id"], []).append((x["distance"], x["id"]))
    assert len(got) == len(asks)
    for i, q in asks:
        assert sorted(got[i]) == sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(e, q))), k) for k, e, _ in rows[:180])[:7]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (5, 6), (6, 5), (7, 7)], "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges, iterations=30, tolerance=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[3] > ranks[2] > ranks[1] and ranks[5] == pytest.approx(ranks[6])
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.bfs(edges, seeds, 5).collect()} == {(1, 0), (2, 1), (3, 2)} and graph.bfs(edges, seeds, 5, 2).count() == 2
    chain = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {1}


_EDGES = [(i % 23, i % 17) for i in range(500)] + [(3, 3), (3, 3), (40, 1), (2, 41)]


def test_neighbors_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 50, raising=False)
    edges = spark.createDataFrame([*_EDGES, (None, 1), (1, None)], "src long, dst long")
    both = set(_EDGES) | {(b, a) for a, b in _EDGES}
    for way, want in (("both", both), ("out", set(_EDGES)), ("in", {(b, a) for a, b in _EDGES})):
        got = graph.neighbors(edges, way)
        assert sorted(map(tuple, got.collect())) == sorted(want) and got.rdd.getNumPartitions() >= 10


def test_bfs_takes_edges_as_they_are(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "settled", lambda df, name, f=graph.settled: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or f(df, name))
    edges = spark.createDataFrame([*_EDGES, (41, None)], "src long, dst long")
    got = graph.bfs(edges, spark.createDataFrame([(40,)], "node long"), 2)
    assert sorted(map(tuple, got.collect())) == sorted([(40, 0), (1, 1)] + [(b, 2) for b in {b for a, b in _EDGES if a == 1} - {1}])
    assert [("Aggregate" in p) for n, p in plans if n == "adjacency"] == [False]


@pytest.mark.parametrize("near", [0, 1 << 20])
def test_bfs_by_tasks_of_bounded_size(spark, monkeypatch, near):
    monkeypatch.setattr(graph, "EDGES", 50)
    monkeypatch.setattr(graph, "NEAR", near, raising=False)
    tasks = []
    monkeypatch.setattr(graph, "settled", lambda df, name, f=graph.settled: tasks.append((name, df.rdd.getNumPartitions())) or f(df, name))
    edges = spark.createDataFrame([*_EDGES, (None, 1), (41, None)], "src long, dst long")
    turned = {(b, a) for a, b in _EDGES}
    for way, start, want in (("out", 40, set(_EDGES)), ("in", 41, turned), ("both", 41, set(_EDGES) | turned)):
        tasks.clear()
        got = graph.bfs(edges, spark.createDataFrame([(start,), (start,), (99,)], "node long"), 4, **({} if way == "out" else {"direction": way})).collect()
        depth, now = {start: 0, 99: 0}, {start}
        for d in range(1, 5):
            now = {b for a, b in want if a in now} - depth.keys()
            depth |= dict.fromkeys(now, d)
        assert sorted(map(tuple, got)) == sorted(depth.items()) and len(depth) > 5
        steps = [n for name, n in tasks if name == "frontier" and n][1:]  # an empty step has none
        assert steps and min(steps) >= (20 if way == "both" else 10)


def test_bfs_queries_tell_no_edges_apart(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "settled", lambda df, name, f=graph.settled: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or f(df, name))
    for name in ("bfs_depth", "bfs_depth_all"):
        queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert [("Aggregate" in p) for n, p in plans if n == "adjacency"] == [False, False]


def test_pagerank_computes_no_step_twice(spark, monkeypatch):
    names = []
    monkeypatch.setattr(graph, "EDGES", 50, raising=False)
    monkeypatch.setattr(graph, "settled", lambda df, name, f=graph.settled: names.append(name) or f(df, name))
    edges = spark.createDataFrame(_EDGES, "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, iterations=7).collect()}
    assert names.count("ranks") == 7
    out, nodes = {}, {x for e in _EDGES for x in e}
    for a, b in set(_EDGES):
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(7):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(rank[x] for x in nodes if x not in out)) / len(nodes))
        for a, to in out.items():
            for b in to:
                new[b] += 0.85 * rank[a] / len(to)
        rank = new
    assert got.keys() == rank.keys() and all(got[x] == pytest.approx(rank[x]) for x in rank)
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_graph_queries_over_whole_tables(spark):
    d, run = "/root/testdata/sf0.001", queries.queries()
    rows = {(r[0], -1 - r[1]) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    both = rows | {(b, a) for a, b in rows}
    assert {tuple(r) for r in run["neighbors_all"](spark, d).collect()} == both
    out = {}
    for a, b in both:
        out.setdefault(a, []).append(b)
    depth, now = {1: 0}, [1]
    for k in (1, 2, 3):
        now = [b for b in dict.fromkeys(b for a in now for b in out.get(a, [])) if b not in depth]
        depth.update(dict.fromkeys(now, k))
    assert {r["node"]: r["depth"] for r in run["bfs_depth_all"](spark, d).collect()} == depth and len(depth) > 1
    rank = dict.fromkeys(out, 1 / len(out))
    for _ in range(10):
        new = dict.fromkeys(out, 0.15 / len(out))
        for a, b in both:
            new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    got = {r["node"]: r["rank"] for r in run["pagerank_all"](spark, d).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 2e-8 for n in rank)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for c, o in spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        a, b = sorted((top(c), top(-1 - o % 500)))
        root[b] = a
    assert {r["node"]: r["component"] for r in run["connected_components_all"](spark, d).collect()} == {n: top(n) for n in list(root)}


def test_text(spark):
    assert [text.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "running", "sky", "agreed", "conflated", "generalization", "été", "at")] == ["caress", "poni", "relat", "hop", "run", "sky", "agre", "conflat", "gener", "été", "at"]
    df = spark.createDataFrame([("the quick brown fox",), ("fox the",), (None,)], "t string")
    assert [r[0] for r in df.select(text.phrase(F.col("t"), "quick fox")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(text.proximity(F.col("t"), "quick fox", 1)).collect()] == [True, False, False]
    assert [r[0] for r in df.select(text.all_terms(F.col("t"), "fox the")).collect()] == [True, True, False]
    words = spark.createDataFrame([("Running",), ("cats",), ("bus",), ("nation",)], "w string")
    assert [r[0] for r in words.select(text.naive_stem(F.col("w"))).collect()] == ["runn", "cat", "bus", "nation"]
    docs = spark.createDataFrame([(1, "Ábc abd"), (2, "xyz")], "id long, t string")
    assert [r["id"] for r in text.bm25(docs, "t", "ab", "id", prefix=True).collect()] == [1]
    hits = hybrid.search(docs, "id", 2, "abd xyz", "t")
    assert {r["id"] for r in hits.collect()} == {1, 2} and hybrid.rescored(hits, docs, "id", "t", "xyz").first()["id"] == 2


def test_prefix_takes_every_term(spark):
    many = spark.range(12_000).select("id", F.concat(F.lit("abc"), F.col("id").cast("string")).alias("t"))
    assert text.bm25(many, "t", "ab", "id", prefix=True).count() == 12_000
    docs = [(1, "aba abb aba x"), (2, "abb y"), (2, "abb y"), (3, "z"), (4, None)]
    ws = [t.split() for _, t in docs if t]
    mean = sum(map(len, ws)) / len(ws)

    def one(w):
        return sum(math.log(1 + (len(ws) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ("aba", "abb") for tf, df in [(w.count(t), sum(t in v for v in ws))])

    got = sorted(tuple(r) for r in text.bm25(spark.createDataFrame(docs, "id long, t string"), "t", "ab", "id", prefix=True).collect())
    assert [r[0] for r in got] == [1, 2, 2] and [r[1] for r in got] == pytest.approx([one(ws[0]), one(ws[1]), one(ws[2])])


def test_geo(spark):
    one = spark.range(1)
    for lat, lon, want in ((42.605, -5.603, "ezs42"), (57.64911, 10.40744, "u4pru"), (-90.0, -180.0, "00000"), (90.0, 180.0, "zzzzz")):
        assert one.select(geo.geohash(F.lit(lat), F.lit(lon), 5)).first()[0] == want
        s, w, n, e = geo.geohash_bounds(want)
        assert s <= lat <= n and w <= lon <= e
    assert geo.geohash_bounds("a!") is None
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    places = {r["h"]: (r["x"], r["y"]) for r in cells.select("x", "y", geo.hilbert(F.col("x"), F.col("y"), 3).alias("h")).collect()}
    assert len(places) == 64 and min(places) >= 0
    assert one.select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0] == pytest.approx(math.pi * 6_371_000)


def test_statistics_and_bags(spark):
    df = spark.createDataFrame([(i % 10, "x" if i else None) for i in range(100)], "a long, b string")
    got = {r["column"]: r for r in stats.analyzed(df).collect()}
    assert got["a"]["distinct"] == 10 and sum(got["a"]["histogram"]) == 100 and got["b"]["nulls"] == 1 and got["b"]["histogram"] is None
    a, b = (spark.createDataFrame([(x,) for x in v], "x long") for v in ([1, 1, None, 2], [1, None]))
    assert sorted(str(r[0]) for r in relational.bag_operation("except", a, b).collect()) == ["1", "2"]
    assert sorted(str(r[0]) for r in relational.set_operation("intersect", True, a, b).collect()) == ["1", "1", "None"]


def test_columnar_and_blobs(spark, tmp_path):
    t = ColumnarTable.write(spark.createDataFrame([(1, 2.0, "x"), (2, None, "7"), (3, 4.0, None)], "i long, f double, s string"), str(tmp_path / "c"))
    assert (t.sum("f"), t.avg("f"), t.min("i"), t.max("f"), t.sum("s")) == (6.0, 2.0, 1.0, 4.0, 7.0)
    assert t.filter_gt("i", 1).count() == 2 and t.filter_eq("s", "x").count() == 1 and t.scan("f").columns == ["f"]
    t.append(spark.createDataFrame([(9, 9.0, "z")], "i long, f double, s string"))
    assert t.scan().count() == 4
    store = BlobStore(spark, str(tmp_path / "b"))
    store.put(spark.createDataFrame([("a.png", bytearray(b"12345")), ("b.bin", bytearray(b"12345")), ("c.txt", bytearray(b"z"))], "name string, content binary"))
    assert store.contents().count() == 2 and store.get("b.bin") == b"12345" and store.get_range("a.png", 1, 3) == b"234" and store.get("no") is None
    store.forget("c.txt")
    assert store.collect_garbage() == 1 and store.contents().count() == 1 and store.collect_garbage() == 0
    assert spark.range(1).select(media_type(F.lit("x/y.JPG")), media_type(F.lit("x"))).first() == ("image/jpeg", "application/octet-stream")


def test_random_series_round_trip():
    r = random.Random(9)
    for _ in range(20):
        v = [r.choice([r.random(), round(r.random(), 2), float(r.randint(-5, 5)), r.uniform(-1e18, 1e18)]) for _ in range(r.randint(1, 60))]
        assert codecs.xor_decode(codecs.xor_encode(v)) == v and codecs.decimal_decode(codecs.decimal_encode(v)) == v
