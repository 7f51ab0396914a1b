"""Quality by language model: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Symbols are 16 bits: code points below U+10000 are themselves (U+0000 is U+FFFE), those beyond fold into the 8,448 of
U+D800 to U+F8FF, which are surrogates or private; 0 is the boundary before a text. A gram of ORDER symbols is one
long, and its context and its last symbols are bits of it.

Counting: tasks count the grams of trusted texts slice by slice, partial counts are added by a shuffle. Lower orders
take continuation counts from the distinct grams one order up. Discounts for counts of 1, 2 and more come from the
counts of counts of each order. Discounted probabilities and context weights lie in shards of some ROWS_PER_SHARD rows,
by the symbol before the last, spread over SPREAD shards by the one before that; so whatever a gram's interpolation
needs is in its shard (rows of order 2 are in all SPREAD of them), but for order 1, at most SYMBOLS figures.

Scoring: documents lie in blocks of neighbouring rows. A block's distinct grams, each once however often and in
however many documents it stands, go to the shards as sorted packed arrays, meet the counts there (the sharded count
join), and come back as log probabilities to where the block's texts wait, packed. So a frequent gram crosses the
network once per block. A shard has a copy for every BLOCKS_PER_COPY blocks, so tasks grow with model and corpus.
Perplexity is per symbol.

Thresholds: per language a quantile of the perplexity of trusted texts that weren't trained on; languages with too few
of those take the quantile of all. The model grows with the trusted text; nothing of it passes through the driver but
counts of counts and the lowest order.

Defined results: a null or empty text has no perplexity and is rejected. A null language counts as `und`. Without
trusted text all grams are alike and nothing is rejected but empty texts. Repeated rows and ids are scored one by
one; labels that repeat an id are trusted if any is. Input columns with the names of result columns are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .common import extended, perhaps, remove, unused, written

ORDER, BITS, SYMBOLS = 4, 16, 1 << 16
M1, M2 = SYMBOLS - 1, SYMBOLS**2 - 1
ROWS_PER_BLOCK = 8192
ROWS_PER_SHARD, SPREAD, BLOCKS_PER_COPY = 1_000_000, 8, 128
#: Tasks of a stage; beyond that each takes several cells one after the other.
MOST_TASKS = 50_000
RESULTS = ["lm_symbols", "perplexity"]


def _symbol_table() -> np.ndarray:
    cp = np.arange(0x110000, dtype=np.int64)
    out = np.where(cp < SYMBOLS, cp, 0xD800 + cp * 2654435761 % 4294967296 % 0x2100)
    out[0] = 0xFFFE
    return out


_table: np.ndarray | None = None


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each code point of the texts, and where each text begins (one more entry: the end)."""
    global _table
    if _table is None:
        _table = _symbol_table()
    cps, off = tk.code_points(texts)
    place = np.arange(len(cps)) + (ORDER - 1) * (tk.owners(off).astype(np.int64) + 1)
    padded = np.zeros(len(cps) + (ORDER - 1) * (len(off) - 1), np.int64)
    padded[place] = _table[cps]
    key = padded[place]
    for k in range(1, ORDER):
        key |= padded[place - k] << (BITS * k)
    return key, off


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def count_grams(texts: DataFrame, most: int = 1 << 21) -> DataFrame:
    """key, n of the texts' grams (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            column = tk.plain(batch.column(0))
            for a, b in tk.slices(column):
                parts.append(np.unique(grams(column.slice(a, b - a))[0], return_counts=True))
                if len(parts) >= 8:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > most:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts.pop()], names=["key", "n"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _merged(parts)], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, after Chen and Goodman; where counts of counts are missing, half of the usual."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], otherwise)


def shard_of(gram: Column | np.ndarray, shards: int, off: Column | int | None = None) -> Column | np.ndarray:
    """The shard of a gram that ends with the symbol before the last, in Spark and in numpy alike. off: where among that
    symbol's shards, if not by the symbol before it."""
    spread = min(SPREAD, shards)
    if isinstance(gram, Column):
        last, before = gram.bitwiseAND(M1), F.shiftrightunsigned(gram, BITS).bitwiseAND(M1)
        mixed = lambda x: (x * 40503).bitwiseXOR(F.shiftright(x, 7))
        return F.pmod(mixed(last) + (F.pmod(mixed(before), F.lit(spread)) if off is None else off), F.lit(shards)).cast("int")
    last, before = gram & M1, (gram >> BITS) & M1
    return ((((last * 40503) ^ (last >> 7)) + ((before * 40503) ^ (before >> 7)) % spread) % shards).astype(np.int32)


@dataclass
class Model:
    """rows: shard, part (2 * order, and one more for context weights), key, value; p1: order 1, by symbol."""

    rows: DataFrame
    p1: np.ndarray
    shards: int


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """A model of all rows of texts (column text)."""
    counts = {ORDER: written(count_grams(texts), "lm-counts")[0]}
    for k in range(ORDER - 1, 0, -1):  # distinct grams one order up, by their last k symbols
        mask = F.lit((1 << (BITS * k)) - 1)
        counts[k] = written(counts[k + 1].groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"lm-counts{k}")[0]
    c, key = F.col("c"), F.col("key")
    found = {k: counts[k].agg(*[F.count(F.when(c == i, 1)) for i in (1, 2, 3, 4)], F.sum("c"), F.count(F.lit(1))).first() for k in counts}
    shards = shards or max(8, -(-2 * sum(r[5] for r in found.values()) // ROWS_PER_SHARD))
    every = F.explode(F.sequence(F.lit(0), F.lit(min(SPREAD, shards) - 1)))
    rows = []
    p1 = np.full(SYMBOLS, 1 / SYMBOLS)
    for k, ones in found.items():
        d1, d2, d3 = discounts(*ones[:4])
        less = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        if k == 1:
            if ones[5]:
                own = counts[1].select("key", ((c - less) / ones[4]).alias("a"), (less / ones[4]).alias("g")).collect()  # at most SYMBOLS
                p1 *= sum(r["g"] for r in own)
                for r in own:
                    p1[r["key"]] += r["a"]
            continue
        by = counts[k].withColumn("h", F.shiftrightunsigned(key, BITS)).withColumn("less", less)
        context = by.groupBy("h").agg(F.sum("c").alias("total"), F.sum("less").alias("off"))
        alpha = by.join(context, "h").select(F.lit(2 * k).alias("part"), "h", "key", ((c - F.col("less")) / F.col("total")).alias("value"))
        gamma = context.select(F.lit(2 * k + 1).alias("part"), "h", F.col("h").alias("key"), (F.col("off") / F.col("total")).alias("value"))
        both = alpha.union(gamma)
        if k == 2:
            rows.append(both.withColumn("at", every).select(shard_of(F.col("h"), shards, F.col("at")).alias("shard"), "part", "key", "value"))
        else:
            rows.append(both.select(shard_of(F.col("h"), shards).alias("shard"), "part", "key", "value"))
    return Model(written(functools.reduce(DataFrame.union, rows), "lm-model")[0], p1, shards)


def log_probabilities(keys: np.ndarray, parts: dict[int, tuple[np.ndarray, np.ndarray]], p1: np.ndarray) -> np.ndarray:
    """ln p of grams of full order, given their shard's rows by part (sorted keys, values)."""
    none = (np.zeros(0, np.int64), np.zeros(0))
    p = p1[keys & M1]
    for k in range(2, ORDER + 1):
        gram = keys & ((1 << (BITS * k)) - 1) if k < ORDER else keys
        context = (gram >> BITS) & ((1 << (BITS * (k - 1))) - 1)
        p = _at(*parts.get(2 * k, none), gram, 0.0) + _at(*parts.get(2 * k + 1, none), context, 1.0) * p
    return np.log(np.maximum(p, 1e-12))


def _packed(keys: np.ndarray) -> bytes:
    return pa.compress(np.diff(keys, prepend=0).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(raw, n * 8, codec="zstd", asbytes=True), np.int64))


def _blocks(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a new first column, the block of each row: neighbours in a file. Documents that don't come
    straight from files are written first."""
    block = unused(docs, "block")
    try:
        return docs.select(F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / ROWS_PER_BLOCK)).alias(block), *docs.columns), block
    except AnalysisException:
        return _blocks(written(docs, "lm-docs")[0])


def requests(blocks: DataFrame, block: str, shards: int) -> DataFrame:
    """block, shard, n, keys: the distinct grams of each block, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            if not len(keys):
                return
            shard = shard_of((keys >> BITS) & M2, shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(now, k, int(cut[k + 1] - cut[k]), _packed(keys[order[cut[k] : cut[k + 1]]])) for k in range(shards) if cut[k + 1] > cut[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "shard", "n", "keys"])

        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), tk.plain(batch.column(1))
            for a, b in _same(ids):
                if now is not None and ids[a] != now:
                    yield from finish()
                    parts = []
                now = int(ids[a])
                for x, y in tk.slices(texts.slice(a, b - a)):
                    parts.append(np.unique(grams(texts.slice(a + x, y - x))[0]))
                    if len(parts) >= 16:
                        parts = [np.unique(np.concatenate(parts))]
        yield from finish()

    return blocks.select(block, "text").mapInArrow(run, "block long, shard int, n long, keys binary")


def _same(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = np.flatnonzero(np.diff(ids)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]) if len(ids) else ()


def answers(asked: DataFrame, model: Model, copies: int = 1) -> DataFrame:
    """block, n, keys, logs: what was asked, with log probabilities (float32)."""
    rows = model.rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("long").alias("block"), "part", "key", "value", F.lit(None).cast("binary").alias("keys"))
    rows = rows.unionByName(asked.select("shard", F.pmod("block", F.lit(copies)).cast("int").alias("copy"), "block", F.lit(0).alias("part"), F.col("n").alias("key"), F.lit(0.0).alias("value"), "keys"))
    cells = min(model.shards * copies, MOST_TASKS)
    rows = rows.withColumn("cell", F.col("copy") * model.shards + F.col("shard")).drop("copy", "shard")
    rows = rows.repartitionById(cells, F.pmod("cell", F.lit(cells))).sortWithinPartitions("cell", F.asc_nulls_first("block"), "part", "key")
    rows = rows.select("cell", "block", "part", "key", "value", "keys")
    p1 = asked.sparkSession.sparkContext.broadcast(model.p1)  # SYMBOLS figures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, parts = None, [], {}
        for batch in batches:
            shard, block = np.asarray(batch.column(0)), batch.column(1)
            out: list[tuple] = []
            for a, b in _same(shard):
                if shard[a] != now:
                    now, held, parts = shard[a], [], {}
                stop = a + block.slice(a, b - a).null_count  # the model's rows come first
                if stop > a:
                    held.append(tuple(np.asarray(batch.column(c).slice(a, stop - a)) for c in (2, 3, 4)))
                if stop < b and held:
                    part, key, value = (np.concatenate(x) for x in zip(*held))
                    cut = np.searchsorted(part, np.arange(2 * ORDER + 3))
                    parts, held = {k: (key[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]]) for k in range(2 * ORDER + 2)}, []
                for i in range(stop, b):
                    n, raw = batch.column(3)[i].as_py(), batch.column(5)[i].as_py()
                    logs = log_probabilities(_unpacked(raw, n), parts, p1.value).astype(np.float32)
                    out.append((block[i].as_py(), n, raw, logs.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "n", "keys", "logs"])

    return rows.mapInArrow(run, "block long, n long, keys binary, logs binary")


def _payloads(blocks: DataFrame, block: str) -> DataFrame:
    """block, payload: the rows of docs, a few MB of text at a time, as compressed Arrow."""
    at = [c for c in blocks.columns if c != block].index("text") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            texts = tk.plain(batch.column(at))
            own = pa.RecordBatch.from_arrays(batch.columns[1:], names=[f"c{i}" for i in range(batch.num_columns - 1)])
            for a, b in _same(np.asarray(batch.column(0))):
                for x, y in tk.slices(texts.slice(a, b - a), 1 << 22):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=options) as stream:
                        stream.write_batch(pa.Table.from_batches([own.slice(a + x, y - x)]).combine_chunks().to_batches()[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    return blocks.mapInArrow(run, "block long, payload binary")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lm_symbols (long) and perplexity (double; null where there is no symbol)."""
    docs = docs.drop(*[c for c in RESULTS if c in docs.columns])
    blocks, block = _blocks(docs)
    copies = 1 + docs.count() // (ROWS_PER_BLOCK * BLOCKS_PER_COPY)
    said, _ = written(answers(requests(blocks, block, model.shards), model, copies), "lm-answers")
    rows = said.select("block", F.lit(0).alias("kind"), "n", "keys", "logs")
    rows = rows.unionByName(_payloads(blocks, block).select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("payload").alias("keys"), F.lit(None).cast("binary").alias("logs")))
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, logs = None, [], None, None
        for batch in batches:
            for i in range(len(batch)):
                block, kind, n, raw, more = (c[i].as_py() for c in batch.columns)
                if block != now:
                    now, held, keys = block, [], None
                if not kind:
                    held.append((_unpacked(raw, n), np.frombuffer(more, np.float32)))
                    continue
                if keys is None:
                    keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64)
                    logs = np.concatenate([x for _, x in held]).astype(np.float64) if held else np.zeros(0)
                    order = np.argsort(keys)
                    keys, logs, held = keys[order], logs[order], []
                own = pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]
                key, off = grams(tk.plain(own.column(at)))
                total = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, key)] if len(key) else [])])
                size = np.diff(off)
                ppl = np.exp(-(total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(size, pa.int64()), pa.array(ppl, mask=size == 0)], names=[*names, *RESULTS])

    return rows.mapInArrow(run, extended(docs.schema, "lm_symbols long, perplexity double"))


def thresholds(calibration: DataFrame, quantile: float, slack: float, least: int) -> DataFrame:
    """lang, threshold: per language the quantile of perplexity, times slack; a null language's row holds for those
    with fewer than least documents. Perplexities are counted in bins of a thousandth of a log, so the sort is over
    bins, not documents."""
    bins = calibration.where("perplexity is not null").select("lang", F.floor(F.log("perplexity") * 1000).alias("bin"))
    both = bins.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))))
    per = both.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")
    per = per.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    per = per.where((F.col("upto") >= F.col("all") * quantile) & (F.col("lang").isNull() | (F.col("all") >= least)))
    return per.groupBy("lang").agg((F.exp((F.min("bin") + 1) / 1000) * slack).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05, least: int = 50, folds: int = 5) -> DataFrame:
    """docs with lm_symbols, perplexity, threshold and kept. Trusted: labelled of quality 1; those with crc32(doc_id)
    mod folds = 0 calibrate the thresholds, scored before the rest, so that no scored text waits for them; the others
    train."""
    docs = docs.drop(*[c for c in ("threshold", "kept") if c in docs.columns])
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    aside = F.crc32(F.col("doc_id").cast("string")) % folds == 0

    def those(ids: DataFrame, *columns: str) -> DataFrame:
        """Columns of the documents of ids: few other texts are moved (a semi-join would be pushed below the marks)."""
        return perhaps(docs.select("doc_id", *columns), "doc_id", ids).join(ids.hint("shuffle_hash"), "doc_id").select(*columns)

    model = train(those(good.where(~aside), "text"))
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    calibration, aside_path = written(those(good.where(aside), "lang", "text"), "lm-aside")
    limits, _ = written(thresholds(scored(calibration, model).select(lang.alias("lang"), "perplexity"), quantile, slack, least), "lm-thresholds")
    remove(docs.sparkSession, aside_path)
    table = scored(docs, model)
    own, general = limits.where("lang is not null").select(F.col("lang").alias("of"), F.col("threshold").alias("own")), limits.where("lang is null").first()
    small = limits.count() <= 100_000
    out = table.join(F.broadcast(own) if small else own, lang == F.col("of"), "left")
    limit = F.coalesce("own", F.lit(general["threshold"] if general else None).cast("double"))
    kept = (F.col("lm_symbols") > 0) & (limit.isNull() | (F.col("perplexity") <= limit))
    return out.select(*table.columns, limit.alias("threshold"), kept.alias("kept"))


def trusted_alike(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the model keeps, with their own columns."""
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("row"), "doc_id", "text", "lang") if {*names} & {*RESULTS, "threshold", "kept"} else docs
    out = judged(inner, labels, **options).where("kept")
    return out.select("row.*") if "row" in inner.columns and inner is not docs else out.select(*names)
