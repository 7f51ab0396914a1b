"""Document fingerprints: digests of improbable features.

Every window of `WINDOW` bytes of a text is ranked by its entropy: windows of low entropy (runs, padding) count for
nothing, and the higher the entropy, the rarer the window. In every run of `RUN` windows the rarest wins (the first
of equals); windows that win `LEAST_WINS` runs or more are the text's features. Features go, in order of place, into
a chain of Bloom filters of `BITS` bits, `PER_FILTER` features each, by `HASHES` hash functions. Two digests are
compared filter by filter: each filter of the shorter chain takes its best partner in the other, by common bits
beyond what chance gives, over the most that could be common.

Defined results: in a text whose windows are all of low entropy they count; one of few windows gives the rarest
quarter of them; one without features (shorter than a window, or alike throughout, so that each run has another first
of equals) gives its 8-byte windows, or itself as a whole; a null or empty text has the empty fingerprint, whose likeness to another empty one is 1 and to any other 0. Texts that are equal have equal
fingerprints and likeness 1. Windows never cross texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import extended
from .ordered import boundaries, bucket

WINDOW, RUN, LEAST_WINS = 32, 64, 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
_c = np.arange(WINDOW + 1, dtype=np.float64)
#: c * log2(c) in whole units of 2**-20, so that sums are exact in any order.
_G = np.round(np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0) * (1 << 20)).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_G)])
#: Entropy is log2(WINDOW) - sum / WINDOW; windows of under 2.5 bits have no rank.
_SCALE = WINDOW << 20
_WEAK = int((np.log2(WINDOW) - 2.5) * _SCALE)


def _entropy_sums(data: np.ndarray) -> np.ndarray:
    """For each window of a byte string, the sum of c * log2(c) over its byte counts: high sum, low entropy."""
    n = len(data)
    order = np.argsort(data, kind="stable").astype(np.int32)
    kind = data[order]
    back = np.ones(n, np.int16)  # by place in order: occurrences of the byte in the window that ends there
    ahead = np.ones(n, np.int16)  # in the window that begins there
    at = np.arange(n - 1)
    for d in range(1, WINDOW):  # pairs of one byte, d of its occurrences apart, in one window; ever fewer
        at = at[: np.searchsorted(at, n - d)]
        at = at[(kind[at + d] == kind[at]) & (order[at + d] - order[at] < WINDOW)]
        if not len(at):
            break
        back[at + d] += 1
        ahead[at] += 1
    m = n - WINDOW
    gain = np.empty(n, np.int64)
    loss = np.empty(n, np.int64)
    gain[order] = _STEP[back]
    loss[order] = _STEP[ahead]
    out = np.empty(m + 1, np.int64)
    out[0] = _G[np.bincount(data[:WINDOW])].sum()
    # one byte leaves, then one enters; its count is over the window that it completes
    np.cumsum(gain[WINDOW:] - loss[:m], out=out[1:])
    out[1:] += out[0]
    return out


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the features (windows) of texts begin; off: where each text begins in data, and the end."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    sums = _entropy_sums(data)
    n = len(sums)
    ends = np.repeat(off[1:], np.diff(off))[:n]  # the end of the text that a window begins in
    place = np.arange(n)
    inside = place + WINDOW <= ends
    # a text that is weak throughout is ranked all the same
    strong = inside & (sums <= _WEAK)
    none = np.bincount(np.searchsorted(off, np.flatnonzero(strong), side="right") - 1, minlength=len(off) - 1) == 0
    usable = np.where(np.repeat(none, np.diff(off))[:n], inside, strong)
    best = (np.where(usable, sums >> 10, np.int64(1) << 30) << 32) | place
    least, width = best, 1
    while width < RUN and len(least) > width:  # least of ever longer runs
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    full = np.flatnonzero(place[: len(least)] + RUN - 1 + WINDOW <= ends[: len(least)]) if width == RUN else place[:0]
    wins = np.bincount(least[full] & 0xFFFFFFFF, minlength=n)
    out = np.flatnonzero((wins >= LEAST_WINS) & usable)
    few = np.flatnonzero((np.diff(off) >= WINDOW) & (np.diff(off) < WINDOW + RUN + LEAST_WINS))
    if not len(few):
        return out
    # texts of few windows: a quarter of them in order of rank
    extra = []
    for i in few.tolist():
        part = best[off[i] : off[i + 1] - WINDOW + 1]
        extra.append(np.sort(part[usable[off[i] : off[i + 1] - WINDOW + 1]])[: max(1, len(part) // 4)] & 0xFFFFFFFF)
    short = np.zeros(len(off), bool)
    short[few] = True
    return np.sort(np.concatenate([out[~short[np.searchsorted(off, out, side="right") - 1]], *extra]))


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its chain of filters, a row of BITS / 8 bytes each."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = features(data, off)
    hashes = tk.span_hashes(data, at, at + WINDOW)
    cut = np.searchsorted(at, off)
    whole = tk.span_hashes(data, off[:-1], off[1:])
    out = []
    for i, t in enumerate(texts):
        h = hashes[cut[i] : cut[i + 1]]
        if not len(t):
            h = h[:0]
        elif not len(h):
            h = whole[i : i + 1] if len(t) < 8 else tk.span_hashes(np.frombuffer(t, np.uint8), np.arange(len(t) - 7), np.arange(8, len(t) + 1))
        h = h[np.sort(np.unique(h, return_index=True)[1])]
        chain = np.zeros((-(-len(h) // PER_FILTER), BITS), bool)
        row = np.arange(len(h)) // PER_FILTER
        for k in range(HASHES):
            chain[row, (h >> tk.U64(12 * k)) & tk.U64(BITS - 1)] = True
        out.append(np.packbits(chain, axis=1))
    return out


def _batched(texts: list[bytes], limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """digests of any number of texts, about limit bytes at a time."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield from digests(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield from digests(held)


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, by the filters of the shorter chain."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    common, chance, most = x @ y.T, nx * ny / BITS, np.minimum(nx, ny)
    chance = np.minimum(chance + 0.3 * (most - chance), most)  # common bits up to here mean nothing
    score = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-6), common >= most)
    return float(np.clip(score, 0, 1).max(1).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as many first code points of the next text, or all of them."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint`, the digest of its text; no order is needed."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index("text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(d) for d in _batched([(t or "").encode() for t in batch.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, extended(docs.schema, "fingerprint string"))


def with_neighbours(docs: DataFrame, rows_per_bucket: int = 8192) -> DataFrame:
    """Each document (doc_id, text) with its edited text's digest and its likeness to that and to the next document's
    (ascending doc_id, null first, equal ids by hash of the text; after the last the first).

    Documents go to buckets of neighbouring ids; the first document of the next bucket follows each bucket's own as a
    guest, so a task reads its rows once, in order, holding two of them."""
    docs = docs.select("doc_id", "text")
    bounds = boundaries(docs, rows_per_bucket)
    tie = F.xxhash64("text")
    placed = docs.select("doc_id", "text", bucket(F.col("doc_id"), bounds).alias("b"), F.lit(False).alias("guest"))
    firsts = placed.groupBy("b").agg(F.min(F.struct("doc_id", tie.alias("tie"))).alias("m"))
    order = sorted(firsts.collect(), key=lambda r: r["b"])  # one row per bucket
    if not order:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {r["b"]: order[i - 1]["b"] for i, r in enumerate(order)}
    guests = docs.sparkSession.createDataFrame([(before[r["b"]], r["m"]["doc_id"], r["m"]["tie"]) for r in order], "b int, first long, tie long")
    guest_rows = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first")) & (tie == F.col("tie"))).select("doc_id", "text", "b", "tie").dropDuplicates(["b"])
    rows = placed.withColumn("tie", tie).unionByName(guest_rows.withColumn("guest", F.lit(True)))
    rows = rows.repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("b", "guest", "doc_id", "tie").select("b", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        last: list[tuple] = []  # the row before, with its digest
        for batch in batches:
            for a, b in tk.slices(tk.plain(batch.column(3))):
                part = [(k, g, i, t or "") for k, g, i, t in zip(*[c.slice(a, b - a).to_pylist() for c in batch.columns])]
                rows = last + [(*r, d) for r, d in zip(part, _batched([r[3].encode() for r in part]))]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0]]
                last = rows[-1:]
                new = [edited(x[3], y[3]) for x, y in pairs]
                out = [
                    (x[2], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), as_text(x[4]), as_text(d), likeness(x[4], d), likeness(x[4], y[4]))
                    for (x, y), e, d in zip(pairs, new, _batched([e.encode() for e in new]))
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
