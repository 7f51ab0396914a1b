"""Graphs as edge tables: neighbours, bounded traversal, components, PageRank, paths.

Edges are DataFrames with src and dst (and, for paths, src_table, dst_table, label, payload, ts_unix). Loops keep
their frontier in written tables; the driver sees counts only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..storage import settled

#: Edges that a task holds, on average, where edges are told apart or sorted.
EDGES = 1 << 20
#: Nodes of a frontier that every executor may hold at once; a larger one meets its edges task by task.
NEAR = 1 << 20


def _whole(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null")


def _tasks(edges: DataFrame) -> int:
    return max(1, -(-edges.count() // EDGES))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges src, dst. Tasks by the number of edges: a task's memory stays the same however many there are."""
    whole = _whole(edges)
    return whole.repartition(_tasks(whole), "src", "dst").distinct()


def ways(edges: DataFrame, direction: str) -> DataFrame:
    """src and dst of edges as they are (out), turned round (in), or as they are and turned round (both; a loop once)."""
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back)))
    return edges.select(*{"out": ["src", "dst"], "in": [F.col("dst").alias("src"), F.col("src").alias("dst")], "both": [both]}[direction])


def neighbors(edges: DataFrame, direction: str = "out") -> DataFrame:
    """src and dst of neighbours: out, in or both (each once)."""
    if direction == "both":  # told apart once, as pairs; a loop is its own way back
        pairs = adjacency(_whole(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
        return ways(pairs, direction)
    return ways(adjacency(edges), direction)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int | None = None, direction: str = "out") -> DataFrame:
    """node and depth of what is reached from the seeds (column node) along edges (out, in or both) in at most depth
    steps; with max_nodes the first by depth, then node. Edges are written once; an edge moves only in the step that it
    belongs to, or, where a frontier is large, to meet it. Tasks by the number of edges."""
    adj = settled(_whole(edges), "adjacency")  # steps tell nodes apart, so edges may be there twice
    tasks = _tasks(adj) * (2 if direction == "both" else 1)
    links = ways(adj, direction)
    seen = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for d in range(1, depth + 1):
        if not (n := frontier.count()):
            break
        here, at = links, F.broadcast(frontier)
        if n > NEAR:
            here, at = links.repartition(tasks, "src"), frontier.repartition(tasks, "node").hint("shuffle_hash")
        step = here.join(at, F.col("node") == F.col("src"), "left_semi").select(F.col("dst").alias("node"))
        new = step.repartition(tasks, "node").distinct().join(seen, "node", "left_anti")
        frontier = settled(new.withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


def roots(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (column node) that no edge leads to; where there are none, candidates with an edge."""
    adj = adjacency(edges)
    free = candidates.join(adj.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    known = adj.select(F.col("src").alias("node")).union(adj.select("dst")).distinct()
    free = free.join(known, "node", "left_semi")
    return candidates.join(known, "node", "left_semi") if free.isEmpty() else free


def traverse(edges: DataFrame, candidates: DataFrame, depth: int) -> DataFrame:
    """node and depth of candidates reached from their roots; the way may lead over others."""
    return bfs(edges, roots(edges, candidates), depth).join(candidates, "node", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable in either direction: alternating large and small stars, which
    need about as many rounds as the logarithm of the longest way."""
    e = settled(adjacency(edges).where("src != dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), "stars")
    sign = lambda t: t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    before = sign(e)
    while before[0]:
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        both = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        e = settled(both.select("hi", F.col("m").alias("lo")).union(both.where("lo > m").select("lo", "m")).distinct(), "stars")
        after = sign(e)
        if after == before:
            break
        before = after
    alone = adjacency(edges).select(F.col("src").alias("node")).union(adjacency(edges).select("dst")).distinct()
    return alone.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 0.0, distinct: bool = False) -> DataFrame:
    """node and rank; what nodes without out-edges hold is shared by all, and ranks sum to 1. It ends after the
    iterations, or when ranks move by less than tolerance in total. distinct: edges are known to be there once each.
    Edges are sorted by src once, on the executors' disks; a step moves ranks and sums, and is written."""
    if not 0 < damping < 1:
        raise ValueError("damping lies between 0 and 1")
    adj = settled(_whole(edges) if distinct else adjacency(edges), "adjacency")
    tasks = _tasks(adj)
    links = adj.repartition(tasks, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    try:
        out = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).select(F.col("src").alias("node"), "degree")
        base = settled(out.unionByName(links.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("degree"))).groupBy("node").agg(F.max("degree").alias("degree")), "nodes")
        n, sinks = base.agg(F.count(F.lit(1)), F.count_if(F.col("degree") == 0)).first()
        if not n:
            return base.select("node", F.lit(0.0).alias("rank"))
        ranks = base.withColumn("rank", F.lit(1.0 / n))
        for _ in range(iterations):
            lost = ranks.where("degree = 0").agg(F.sum("rank")).first()[0] if sinks else 0.0
            shares = ranks.where("degree > 0").select("node", (F.col("rank") / F.col("degree")).alias("got")).repartition(tasks, "node")
            got = links.join(shares, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "got", F.lit(0).cast("long").alias("degree"))
            sums = got.unionByName(base.select("node", F.lit(0.0).alias("got"), "degree")).groupBy("node").agg(F.sum("got").alias("got"), F.max("degree").alias("degree"))
            new = settled(sums.select("node", "degree", ((1 - damping) / n + damping * (F.col("got") + lost / n)).alias("rank")), "ranks")
            moved = new.join(ranks.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] if tolerance else None
            ranks = new
            if moved is not None and moved < tolerance:
                break
        total = ranks.agg(F.sum("rank")).first()[0]
        return ranks.select("node", (F.col("rank") / total).alias("rank"))
    finally:
        links.unpersist()


def paths(edges: DataFrame, starts: DataFrame, table: str, hops: Iterable[tuple[bool, str, str]], fields: tuple[str, ...] = ()) -> DataFrame:
    """start and value for the nodes in starts (column start, of table): ids at the end of the hops (out, label, table),
    each node once a hop, joined by commas; with fields what the last edges hold, as JSON (an array if several)."""
    now = starts.select("start", F.col("start").alias("node"), F.lit(table).alias("at")).distinct()
    last = now.withColumn("payload", F.lit(None).cast("string")).withColumn("ts_unix", F.lit(None).cast("long"))
    for out, label, to in hops:
        own, other = ("src", "dst") if out else ("dst", "src")
        e = edges.where((F.col("label") == label) & (F.col(f"{other}_table") == to)).select(
            F.col(f"{own}_table").alias("_t"), F.col(own).alias("_n"), F.col(other).alias("next"), "payload", "ts_unix"
        )
        step = now.join(e, (F.col("node") == F.col("_n")) & (F.col("at") == F.col("_t"))).select("start", F.col("next").alias("node"), F.lit(to).alias("at"), "payload", "ts_unix")
        last = step.groupBy("start", "node", "at").agg(F.min(F.struct("payload", "ts_unix")).alias("m")).select("start", "node", "at", "m.payload", "m.ts_unix")
        now = last.select("start", "node", "at")
    if fields:
        keep = [F.when(F.col("payload").isNotNull(), F.parse_json("payload")).alias("payload"), F.col("ts_unix")]
        objects = F.transform(F.array_sort(F.collect_list(F.struct("node", F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
        one = F.when(F.size(objects) == 1, F.get(objects, 0)).otherwise(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))
        return last.groupBy("start").agg(one.alias("value"))
    return last.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ",").alias("value"))
