"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target is its weight's part of the total, up to a cap; what a cap refuses is shared again by weight.
The mixture is cut into equal blocks of tokens, and blocks go to sources by the highest quotients target / (2s + 1).
A source's documents lie in hash shards of bounded size; its blocks go to its shards in the same way, by their
tokens. Inside a shard the documents follow one another in an order seeded by hash, as one line of blocks: every
block is taken as often as the quota holds whole turns, and the rest of the quota takes blocks from a seeded place
on, round the end. A document's part in the mixture is what the taken blocks cover of it.

Quotas are computed on the driver from one row per source and one per shard (a shard is shard_rows documents of a
source), never from documents.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order;
null and repeated ids are documents like others, told apart by their texts (rows alike in both may stand for each other). A source
without words has target 0. Input columns with the names of result columns are replaced. Reruns agree.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, word_count, written

RESULTS = ["size", "source_size", "target", "taken"]


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """total shared by weight, none above cap times its size; the excess shared again by weight until none is."""
    open_, out, left = [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients share / (2s + 1); equal quotients go to the first. All seats that the quotients
    surely win are given at once, so the work depends on the number of shares, not of seats."""
    total = sum(shares)
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    # rounding with a divisor a little too large gives at most all seats, and just what the first quotients win
    scale = max(0.0, seats - len(shares) / 2 - 1) / total
    out = [max(0, math.ceil(s * scale - 0.5)) for s in shares]
    queue = [(-s / (2 * n + 1), i) for i, (s, n) in enumerate(zip(shares, out)) if s > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        heapq.heappush(queue, (-shares[i] / (2 * out[i] + 1), i))
    return out


def _small(table: DataFrame, rows: int) -> DataFrame:
    """For a join: sent to all tasks where it has 200,000 rows at most."""
    return F.broadcast(table) if rows <= 200_000 else table


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 7, shard_rows: int = 200_000) -> DataFrame:
    """docs with size (words), source_size, target (of the source) and taken (words that the mixture takes, repeats
    counted; at most cap times size). weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))  # the text tells rows of one id apart
    sized, _ = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("h")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in per_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total_share * sum(sizes), cap)
    quota = sainte_lague(goal, round(sum(goal) / block))
    plan = [(r["source"], r["size"], g, max(1, -(-r["n"] // shard_rows))) for r, g in zip(per_source, goal)]
    schema = "source string, source_size long, target double, n_shards int"
    sources = spark.createDataFrame([(s, z, g, n) for s, z, g, n in plan], schema)
    key = F.col("d.source").eqNullSafe(F.col("p.source"))
    sharded = sized.alias("d").join(_small(sources, len(plan)).alias("p"), key).select("d.*", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed + 1), "d.h"), F.col("n_shards")).cast("int").alias("shard"))
    lengths: dict = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        lengths.setdefault(r["source"], {})[r["shard"]] = r["size"]
    quotas = []
    for (source, size, _, _), blocks in zip(plan, quota):
        shards = sorted(lengths.get(source, {}).items())
        for (k, length), q in zip(shards, sainte_lague([float(n) for _, n in shards], blocks)):
            tokens = min(q * block, math.floor(cap * length))
            turns, rest = divmod(tokens, length) if length else (0, 0)
            quotas.append((source, k, length, turns, rest))
    table = spark.createDataFrame(quotas, "source string, shard int, length long, turns long, rest long")
    line = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded.withColumn("end", F.sum("size").over(line))
    key = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))
    placed = placed.alias("d").join(_small(table, len(quotas)).alias("q"), key).select("d.*", "length", "turns", "rest")
    # the rest covers [start, start + rest) of the line, in blocks from a seeded one on, round the end
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / block))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n_blocks) * block
    a, b = F.col("end") - F.col("size"), F.col("end")
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(b, hi) - F.greatest(a, lo))
    stop = start + F.col("rest")
    rest = over(start, F.least(stop, F.col("length"))) + F.when(stop > F.col("length"), over(F.lit(0), stop - F.col("length"))).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("turns") * F.col("size") + rest).cast("long").alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture with their own columns: each as often as the mixture takes it, rounded to whole
    documents. Rows with one id and source share what they are taken, largest first."""
    names = docs.columns
    copies, size = unused(docs, "copies"), unused(docs, "size")
    taken = mixed(docs.select("doc_id", "source", "text"), **options)
    # one row per (id, source, size): rows alike are taken alike, on average
    per = taken.groupBy("doc_id", "source", "size").agg(F.round(F.sum("taken") / F.greatest(F.lit(1), F.sum("size"))).cast("int").alias("k")).where("k > 0")
    d, p = docs.withColumn(size, word_count(F.col("text"))).alias("d"), per.alias("p")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col(f"d.{size}") == F.col("p.size"))
    joined = d.join(p, on).select(*[F.col(f"d.`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("p.k"))).alias(copies))
    return joined.select(*names)
