"""Best-fit packing of documents into bins of equal capacity, under conflicts.

A bin takes no two documents of one duplicate cluster, and no more than source_limit of one source. Documents come by
falling size (best fit decreasing); each goes into the open bin of least residual that still holds it and doesn't
conflict, the search going on to the next larger residual until one is found, else into a new bin. Bins are ordered by
residual in a bitset over capacities; each carries a bitmap of the sources that it has enough of and one of its
clusters, and bins of equal residual lie together by the part of these bitmaps that many documents would meet, so a
document passes over all of them at once. What is longer than a bin is cut: whole bins first, the rest is packed.

Documents lie in hash shards of bounded size (shard_rows), packed each on its own; shards lose at most the room in
their last bins. A hot source or cluster is spread over the shards evenly.

Defined results: a null or empty text has no words and no bin (one row, bin_id null). A null source is a source. Null
and repeated ids are documents like others; repeated texts are one cluster. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

OUT = "bin_id long, place int, doc_id long, source string, cluster long, piece int, start long, n_words long"
#: Clusters with so many members in a shard get a bit in the key that bins of one residual are grouped by.
HOT = 16


class Shelf:
    """Open bins of one shard."""

    def __init__(self, capacity: int, source_limit: int) -> None:
        self.capacity, self.limit = capacity, source_limit
        self.residuals = 0  # bit r: some open bin has residual r
        self.groups: dict[int, dict[int, list[int]]] = {}
        self.left: list[int] = []
        self.full_sources: list[int] = []  # by bin: sources it may take no more of
        self.counts: list[dict[int, int]] = []
        self.clusters: list[int] = []  # by bin: bitmap of the clusters that have more members
        self.filled: list[int] = []

    def _put(self, b: int, key: int) -> None:
        r = self.left[b]
        if r:
            self.groups.setdefault(r, {}).setdefault(key, []).append(b)
            self.residuals |= 1 << r

    def _find(self, size: int, avoid: int, cluster_bit: int) -> tuple[int, int] | None:
        """(bin, its group's key), taken out of its group."""
        rest = self.residuals >> size
        r = size - 1
        while rest:
            step = (rest & -rest).bit_length()
            r += step
            rest >>= step
            groups = self.groups[r]
            for key, bins in groups.items():
                if key & avoid:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not self.clusters[bins[i]] & cluster_bit:
                        b = bins.pop(i)
                        if not bins:
                            del groups[key]
                            if not groups:
                                del self.groups[r]
                                self.residuals &= ~(1 << r)
                        return b, key
        return None

    def add(self, size: int, source: int, cluster: int | None, hot: int | None, n_sources: int) -> tuple[int, int]:
        """(bin, place in it) of a piece. cluster, hot: bit numbers, if the cluster has other members (many)."""
        cluster_bit = 1 << cluster if cluster is not None else 0
        hot_bit = 1 << (n_sources + hot) if hot is not None else 0
        found = self._find(size, (1 << source) | hot_bit, cluster_bit)
        if found is None:
            b, key = len(self.left), 0
            self.left.append(self.capacity)
            self.counts.append({})
            self.clusters.append(0)
            self.filled.append(0)
        else:
            b, key = found
        self.left[b] -= size
        self.clusters[b] |= cluster_bit
        n = self.counts[b][source] = self.counts[b].get(source, 0) + 1
        if n >= self.limit:
            key |= 1 << source
        self._put(b, key | hot_bit)
        self.filled[b] += 1
        return b, self.filled[b] - 1


def pack_shard(shard: int, rows: list[tuple], capacity: int, source_limit: int) -> Iterator[tuple]:
    """Rows of OUT for rows (doc_id, source, cluster, size) of one shard."""
    sources = {s: i for i, s in enumerate(dict.fromkeys(r[1] for r in rows))}
    members = Counter(r[2] for r in rows)
    cluster_bit = {c: i for i, c in enumerate(c for c, n in members.items() if n > 1)}
    hot_bit = {c: i for i, c in enumerate(c for c, n in members.items() if n >= HOT)}
    shelf = Shelf(capacity, source_limit)
    base = shard << 32
    own = 1 << 31  # whole bins count from here
    pieces = []
    for doc_id, source, cluster, size in rows:
        whole, rest = divmod(size, capacity)
        for k in range(whole):
            yield base + own, 0, doc_id, source, cluster, k, k * capacity, capacity
            own += 1
        if rest:
            pieces.append((rest, doc_id, source, cluster, whole))
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[3]))
    for rest, doc_id, source, cluster, k in pieces:
        b, place = shelf.add(rest, sources[source], cluster_bit.get(cluster), hot_bit.get(cluster), len(sources))
        yield base + b, place, doc_id, source, cluster, k, k * capacity, rest


def packed(docs: DataFrame, capacity: int = 2048, source_limit: int | None = None, shard_rows: int = 8192, cluster: str | None = None) -> DataFrame:
    """The rows of OUT for docs (doc_id, source, text): one per piece, and one without bin per document without words.
    source_limit: unless given, 8 times the largest source's share of the documents, at least 2, so that bins can be
    filled where one source has most documents. cluster names a column (long) of duplicate clusters; else texts alike but for case and spacing are one."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    key = F.col(cluster).cast("long") if cluster else F.xxhash64(norm)
    sized = docs.select("doc_id", "source", key.alias("cluster"), word_count(F.col("text")).alias("n_words"))
    per = docs.groupBy("source").count().agg(F.sum("count"), F.max("count")).first()
    total, largest = per[0] or 0, per[1] or 0
    source_limit = source_limit or max(2, -(-8 * largest // max(1, total)))
    shards = max(1, -(-total // shard_rows))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "doc_id", "n_words", "cluster"), F.lit(shards)).cast("int"))
    rows = sized.repartition("shard").sortWithinPartitions("shard").select("shard", "doc_id", "source", "cluster", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        names = [x.split()[0] for x in OUT.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

        def finish() -> Iterator[pa.RecordBatch]:
            out = [(None, None, i, s, c, 0, 0, 0) for i, s, c, n in held if not n]
            for row in pack_shard(now or 0, [r for r in held if r[3]], capacity, source_limit):
                out.append(row)
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for shard, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != now:
                    if held:
                        yield from finish()
                    now, held = shard, []
                held.append(tuple(row))
        if held:
            yield from finish()

    return rows.mapInArrow(run, OUT)
