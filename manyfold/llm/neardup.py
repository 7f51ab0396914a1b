"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct shingles of `width` words as 64-bit hashes; its sketch is the k smallest of them.
Documents with one set are one class. Of a pair at the threshold, the sketch of the union holds k * percent / 100
shared values on average; `least_shared` is the number that it holds with a probability of all but `miss` (binomial
tail; 0: one value, so nothing is left to chance but that a pair above the threshold shares none of k). Sets of k
shingles or fewer lie whole in their sketch: nothing is estimated there.

Each class enters the inverted lists of its rarest values only, as many as make one meeting sure (prefix filtering by
document frequency). Lists are kept by bands of set size, a factor of 100 / percent wide; a class stands in its own
band and the next, so members of a list differ little in size and any pair that can reach the threshold meets. A
list's members meet its first member; sizes and an estimate on the union's sketch drop most meetings, and exact
Jaccard on full sets confirms the rest. Lists whose members are then still in several components go to blocks of
bounded size, where every pair that no link has joined yet is estimated, and confirmed in the same way; blocks of one
component alone don't meet. What leaves a block is links that join components, at most one less than its members.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words
than the width make one shingle. Null ids take no part: component_id null, kept true. Rows that repeat an id with one
text share their class; with different texts each has its own component, named by the same id where it is smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import perhaps, remove, unused, written

BLOCK = 512
#: Ids (three longs each) that may be sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def least_shared(k: int, percent: int, miss: float) -> int:
    """The largest m so that fewer than m of k draws at the threshold are shared with probability miss at most."""
    t, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if below > miss:
            return max(1, m)
    return k


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted int64 hashes."""
    for a, b in tk.slices(texts):
        part = texts.slice(a, b - a)
        data, off = tk.utf8(part)
        starts, _, h = tk.words(data, off)
        first = np.searchsorted(starts, off)  # each text's first word
        n = np.diff(first)
        joined = np.zeros(len(h), np.uint64)
        size = np.minimum(np.repeat(n, n), width)  # a shorter text is one shingle
        for k in range(width):
            usable = np.flatnonzero(size > k)
            usable = usable[usable + k < len(h)]
            joined[usable] = tk.mix(joined[usable] * tk.U64(0x9E3779B97F4A7C15) + h[usable + k] + tk.U64(k))
        signed = joined.view(np.int64)
        for i in range(len(n)):
            count = n[i] - width + 1 if n[i] >= width else min(n[i], 1)
            yield np.unique(signed[first[i] : first[i] + count])


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(int(tk.mix(u + tk.U64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x51ED270B, 0xA3EC647659359ACD))


def sketched(docs: DataFrame, width: int, k: int, tag: bool = False) -> DataFrame:
    """doc_id, n (size of the set), s1, s2 (128 bits of the set), sketch and, with tag, h (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sketches = [], [], [], []
            for s in shingles(tk.plain(batch.column(1)), width):
                one, two = _set_hash(s)
                n.append(len(s))
                s1.append(one)
                s2.append(two)
                sketches.append(s[:k])
            off = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(s) for s in sketches], out=off[1:])
            values = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(off), values), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "sketch", "h"][: len(columns)])

    rows = docs.select("doc_id", "text", *([F.xxhash64("text").alias("h")] if tag else []))
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>" + (", h long" if tag else ""))


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, k: int, repeats: bool) -> DataFrame:
    """cid and the whole set (int64s on end) of the classes in ids (cid): from the sketch where it is the whole set, else
    from the text of the document that leads the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, raw = [], []
            for i, s in enumerate(shingles(tk.plain(batch.column(1)), width)):
                if _set_hash(s) == (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()):  # not another text of that id
                    keep.append(i)
                    raw.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], names=["cid", "items"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(s.values, np.int64).tobytes() for s in batch.column(1)], pa.binary())], names=["cid", "items"])

    small = classes.where(F.col("n") <= k).join(ids, "cid").select("cid", "sketch").mapInArrow(whole, "cid long, items binary")
    large, path = written(classes.where(F.col("n") > k).join(ids, "cid").select("cid", "lead", "s1", "s2"), "neardup-large")
    rows = docs.select("doc_id", "text")
    if large.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(large), F.col("doc_id") == F.col("lead"))
    else:
        rows = perhaps(rows, "doc_id", large.select("lead")).join(large, F.col("doc_id") == F.col("lead"))
    out = rows.select("cid", "text", "s1", "s2").mapInArrow(run, "cid long, items binary")
    return small.union(out.dropDuplicates(["cid"]) if repeats else out)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    both = int((c[1:] == c[:-1]).sum())
    return 100 * both >= percent * (len(c) - both)


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity estimated on the bottom-k sketch of the union, from the sketches of both."""
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    twice = np.append(c[1:] == c[:-1], False)
    after = np.append(False, twice[:-1])
    union = c[~after][:k]
    return float((c[twice] <= union[-1]).sum()) / len(union) if len(union) else 0.0


def components(edges: DataFrame, name: str, most_rounds: int = 200) -> DataFrame:
    """node, comp (the smallest node reachable) of every node with an edge (a, b), by alternating stars. Edges are
    written at each turn; nothing of them reaches the driver but a count and a checksum."""
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    e, path = written(e, name)
    sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    for _ in range(most_rounds if sign[0] else 0):
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        both = large.join(small, "hi").select("hi", "lo", "m")
        out = both.select("hi", F.col("m").alias("lo")).union(both.where("lo > m").select(F.col("lo"), F.col("m"))).distinct()
        new, new_path = written(out, name)
        new_sign = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        remove(e.sparkSession, path)
        e, path = new, new_path
        if new_sign == sign:
            break
        sign = new_sign
    else:
        if sign[0]:
            raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(e.select("lo", "lo")).distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first column, the other columns' rows) of rows in order of the first column."""
    now, held = None, []
    for batch in batches:
        for group, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if group != now:
                if held:
                    yield now, held
                now, held = group, []
            held.append(row)
    if held:
        yield now, held


def _meetings(comps: np.ndarray, top: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], k: int, percent: int, least: int, done: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Members of a block pair, of two components, that sizes, shared sketch values and the estimate let meet. Two
    members of the lower band (not top) meet in that band's list. comps may change between one pair and the next: what
    is then of one component doesn't meet any more, nor do two that are done."""
    _, where, often = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    off = np.concatenate([[0], np.cumsum([len(s) for s in sketches])])
    holders = np.repeat(np.arange(len(sketches)), np.diff(off))[np.argsort(where, kind="stable")]
    begins = np.cumsum(often) - often
    for i in range(len(sketches) - 1):
        big, little = np.maximum(n[i + 1 :], n[i]), np.minimum(n[i + 1 :], n[i])
        ok = (100 * little >= percent * big) & (comps[i + 1 :] != comps[i]) & (top[i + 1 :] | top[i])
        if done is not None and done[i]:
            ok &= ~done[i + 1 :]
        if not ok.any():
            continue
        own = where[off[i] : off[i + 1]]
        shared = np.bincount(holders[tk.ragged(begins[own], often[own])], minlength=len(sketches))[i + 1 :]
        whole = big <= k  # both sketches are whole sets
        ok &= np.where(whole, 100 * shared >= percent * (big + little - shared), shared >= np.minimum(least, np.ceil(little * percent / 100)))
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            if comps[i] != comps[j] and not (done is not None and done[i] and done[j]) and (whole[j - i - 1] or estimate(sketches[i], sketches[j], k) * k >= least):
                yield i, j


def _hopeful(pairs: DataFrame, *limits) -> DataFrame:
    """Rows (pair, cid, comp, top) of block pairs (pair, cid, comp, top, n, sketch) whose member may meet another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, rows in _grouped(batches):
            comps, top, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            there = np.zeros(len(rows), bool)
            for i, j in _meetings(comps, top, n, [np.array(r[4], np.int64) for r in rows], *limits, done=there):
                there[[i, j]] = True
            found = np.flatnonzero(there).tolist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([pair] * len(found), pa.int64()), *(pa.array([rows[i][c] for i in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["pair", "cid", "comp", "top"])

    return pairs.mapInArrow(run, "pair long, cid long, comp long, top boolean")


def _resolve(pairs: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Links (a, b) that join components inside block pairs: rows (pair, cid, comp, top, items) in order of pair."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        comps, sets = np.array([r[1] for r in rows]), [np.frombuffer(r[3], np.int64) for r in rows]
        for i, j in _meetings(comps, np.array([r[2] for r in rows]), np.array([len(s) for s in sets]), [s[:k] for s in sets], k, percent, least):
            if alike(sets[i], sets[j], percent):
                comps[comps == comps[j]] = comps[i]
                yield rows[i][0], rows[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            found = list(links(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _verified(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm. Each set travels to where its first member's is read, once a pair; the
    members of a large group are spread over tasks."""
    many = candidates.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("parts"))
    placed = candidates.join(many, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")).alias("g"))
    rows = placed.select("g", F.lit(0).alias("role"), F.col("a").alias("cid")).distinct().union(placed.select("g", F.lit(1), "b"))
    rows = rows.join(sets, "cid").select("g", "role", "cid", "items").repartition("g").sortWithinPartitions("g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, a = None, None, None
        for batch in batches:
            out = []
            for g, role, cid, items in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(items, np.int64)
                if not role:
                    now, first, a = g, own, cid
                elif g == now and alike(first, own, percent):
                    out.append((a, cid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, miss: float = 1e-8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every row of docs (doc_id, text)."""
    out = _named(docs, width, percent, k, miss)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _named(docs: DataFrame, width: int, percent: int, k: int, miss: float, tag: bool = False) -> DataFrame:
    """doc_id, n, component (the smallest id in it) and group (a key of the component) of every row; with tag, h."""
    spark, t, least = docs.sparkSession, percent / 100, least_shared(k, percent, miss)
    wide, wide_path = written(sketched(docs, width, k, tag), "neardup-rows")
    usable = wide.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("lead"), F.first("sketch").alias("sketch"))
    classes, _ = written(classes.withColumn("cid", F.monotonically_increasing_id()), "neardup-classes")
    rows, _ = written(wide.drop("sketch"), "neardup-slim")
    remove(spark, wide_path)

    values = classes.select("cid", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # moved as plain rows: partial lists of a value or two would take more room
    held = values.join(often, "v").select("cid", "df", "v").repartition("cid").groupBy("cid").agg(F.collect_list(F.struct("df", "v")).alias("vs"))  # at most k values
    must = F.when(F.col("n") >= k, least).otherwise(F.least(F.lit(least), F.ceil(F.col("n") * t)))
    held = held.join(classes.select("cid", "n"), "cid").where(F.size("vs") >= must)
    prefix = F.slice(F.sort_array("vs"), F.lit(1), (F.size("vs") - must + 1).cast("int"))
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(min(t, 0.99)) * (1 + 1e-9))).cast("int")
    entries = held.select("cid", "n", F.explode(prefix).alias("x")).select(F.col("x.v").alias("v"), "cid", "n", own.alias("own"))
    entries = entries.select("v", "cid", "n", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"), "own").select("v", "band", "cid", "n", (F.col("own") == F.col("band")).alias("top"))
    entries, entries_path = written(entries, "neardup-lists")

    first = entries.groupBy("v", "band").agg(F.min(F.struct("cid", "n")).alias("a"), F.count(F.lit(1)).alias("size"), F.bool_or("top").alias("any")).where("size > 1 and any")
    in_lists = entries.join(first, ["v", "band"]).select("v", "band", F.col("a.cid").alias("a"), F.col("a.n").alias("na"), "cid", "n", "top", "size")
    meetings = in_lists.where("cid > a").where(100 * F.least("na", "n") >= percent * F.greatest("na", "n")).select("a", F.col("cid").alias("b")).distinct()
    small = classes.select("cid", "n", "sketch")
    side = lambda x: small.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = meetings.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    met = met.withColumn("u", union).withColumn("both", F.array_intersect("sa", "sb"))
    estimated = F.size(F.array_intersect("u", "both")) * k >= least * F.size("u")
    exactly = 100 * F.size("both") >= percent * (F.col("na") + F.col("nb") - F.size("both"))  # both sketches are whole sets
    met = met.where(F.when(F.greatest("na", "nb") <= k, exactly).otherwise(estimated))
    candidates, candidates_path = written(met.select("a", "b"), "neardup-candidates")

    repeats = not usable_ids(rows).isEmpty()
    ids = candidates.select(F.col("a").alias("cid")).union(candidates.select("b")).distinct()
    sets, sets_path = written(_sets(docs, classes, ids, width, k, repeats), "neardup-sets")
    links, _ = written(_verified(candidates, sets, percent), "neardup-links")
    for path in (sets_path, candidates_path):
        remove(spark, path)
    comp, _ = written(components(links, "neardup-stars"), "neardup-comp")

    # a list's first member has met all others: only lists of three or more may hold pairs that haven't met. Lists with
    # one first member among the rest of a band are one family
    others = in_lists.where("cid > a and size > 2").select("v", "band", "cid", "top")
    labelled, labelled_path = written(others.join(comp, F.col("cid") == F.col("node"), "left").select("v", "band", "cid", "top", F.coalesce("comp", "cid").alias("comp")), "neardup-others")
    remove(spark, entries_path)
    open_ = labelled.groupBy("v", "band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bool_or("top").alias("any"), F.min("cid").alias("f")).where("c0 < c1 and any")
    open_ = open_.select("v", "band", F.xxhash64("f", "band").alias("family"))
    member, _ = written(labelled.join(open_, ["v", "band"]).select("family", "cid", "comp", "top").distinct(), "neardup-loose")
    remove(spark, labelled_path)
    # blocks of about BLOCK members: a large component has its own, small ones of a family share
    per = member.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("size")).withColumn("own", F.col("size") >= BLOCK // 2)
    pool = per.where("not own").groupBy("family").agg(F.sum("size").alias("pool"))
    per = per.join(pool, "family", "left").select(
        "family", "comp", F.when(F.col("own"), F.col("comp")).alias("pure"),
        F.when(F.col("own"), F.ceil(F.col("size") / BLOCK)).otherwise(F.ceil(F.coalesce("pool", F.lit(1)) / BLOCK)).alias("n_blocks"),
    )
    member = member.join(per, ["family", "comp"]).select("family", "cid", "comp", "top", "pure", F.pmod(F.xxhash64("cid"), "n_blocks").alias("blk"))
    block = F.xxhash64("family", F.coalesce("pure", F.lit(-1)), "blk", F.col("pure").isNull())
    member, _ = written(member.withColumn("block", block), "neardup-members")
    blocks = member.groupBy("family", "pure", "block").agg(F.bool_or("top").alias("any"))
    left, right = blocks.alias("l"), blocks.alias("r")
    meet = left.join(right, (F.col("l.family") == F.col("r.family")) & (F.col("l.block") <= F.col("r.block")) & (F.col("l.any") | F.col("r.any")))
    meet = meet.where(F.col("l.pure").isNull() | F.col("r.pure").isNull() | (F.col("l.pure") != F.col("r.pure")))
    meet = meet.select(F.xxhash64("l.block", "r.block").alias("pair"), F.explode(F.array_distinct(F.array(F.col("l.block"), F.col("r.block")))).alias("block"))
    limits, tasks = (k, percent, least), int(spark.conf.get("spark.sql.shuffle.partitions"))  # work, not bytes: not to be merged
    work = member.select("block", "cid", "comp", "top").join(meet, "block").join(small, "cid").select("pair", "cid", "comp", "top", "n", "sketch")
    hopeful, _ = written(_hopeful(work.repartition(tasks, "pair").sortWithinPartitions("pair", "cid"), *limits), "neardup-hopeful")
    late_sets, late_path = written(_sets(docs, classes, hopeful.select("cid").distinct(), width, k, repeats), "neardup-sets")
    work = hopeful.join(late_sets, "cid").select("pair", "cid", "comp", "top", "items")
    late, _ = written(_resolve(work.repartition(tasks, "pair").sortWithinPartitions("pair", "cid"), *limits), "neardup-late")
    remove(spark, late_path)
    final, _ = written(components(late.union(comp.select("node", "comp")), "neardup-stars"), "neardup-final")

    names = classes.select("cid", "lead").join(final, F.col("cid") == F.col("node")).groupBy("comp").agg(F.min("lead").alias("low"))
    low = final.join(names, "comp").select("node", "comp", "low")
    named = classes.join(low, F.col("cid") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("comp", "cid").alias("group"), F.coalesce("low", "lead").alias("component"))
    return rows.join(named, ["s1", "s2", "n"], "left").select("doc_id", "n", "component", "group", *(["h"] if tag else []))


def usable_ids(rows: DataFrame, *more: str) -> DataFrame:
    """The ids (and more) that stand on several rows with a set."""
    return rows.where("n > 0 and doc_id is not null").groupBy("doc_id", *more).count().where("count > 1")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, miss: float = 1e-8) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id, of several texts under that
    id the one with the smallest hash, of equal rows any."""
    h = unused(docs, "h")
    rows, _ = written(_named(docs, width, percent, k, miss, tag=True), "neardup-named")
    usable = rows.where("n > 0 and doc_id is not null")
    best = usable.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    gone = usable.join(best, "group").where(F.struct("doc_id", "h") != F.col("best")).select(F.col("doc_id").alias("i"), F.col("h").alias("j")).distinct()
    gone, _ = written(gone, "neardup-gone")
    few = gone.count() <= MOST_BROADCAST
    kept = docs.withColumn(h, F.xxhash64("text")).join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("i")) & (F.col(h) == F.col("j")), "left_anti")
    if usable_ids(rows, "h").isEmpty():
        return kept.select(*docs.columns)
    again = usable_ids(rows, "h").select(F.col("doc_id").alias("i"), F.col("h").alias("j"))
    alone = kept.join(again, (F.col("doc_id") == F.col("i")) & (F.col(h) == F.col("j")), "left_anti")
    several = kept.join(again, (F.col("doc_id") == F.col("i")) & (F.col(h) == F.col("j")), "left_semi")
    return alone.unionByName(several.dropDuplicates(["doc_id", h])).select(*docs.columns)
