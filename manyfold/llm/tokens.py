"""Token ids in a binary file format: patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of BLOCK ids. A block stores its minimum and its ids' offsets
from it, packed at the narrowest width that `PERCENT` of them fit; those that don't keep their low bits in place, and
their place and high bits stand in the block's exception list. An index has where each block begins, and the
documents' ids and lengths, so any document is read without the rest.

    "MFT1", u32 n_blocks, u32 n_docs, u64 n_ids
    u64 block starts [n_blocks + 1], from the first block's byte
    i64 doc ids [n_docs], u64 lengths [n_docs], u8 whether the id is null [n_docs]
    blocks: u32 minimum, u16 n, u8 width, u8 0, u16 n_exceptions, packed ids, u16 places, u32 high bits

Files are written by tasks under another name and renamed when whole. Each bucket of neighbouring document ids is a
task of its own and gives a file for every IDS_PER_FILE ids (a longer document is not split), so no task holds more,
however large a bucket; a task that runs again replaces its files by the same bytes.

Defined results: a null or empty text has no ids but the end id; null doc ids come first and stay null; rows that
repeat an id follow one another by hash of the text; an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import boundaries, bucket

BLOCK, PERCENT = 1024, 95
IDS_PER_FILE = 1 << 22
#: Blocks that are encoded or decoded together.
AT_ONCE = 64
MAGIC = b"MFT1"
U64 = np.uint64
_HEAD = struct.Struct("<4sIIQ")
_BLOCK = struct.Struct("<IHBBH")


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of width bits on end, the lowest bit first."""
    if not width:
        return b""
    if width > 16:
        bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
        return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    eights = np.zeros((-(-len(values) // 8), 8), np.uint64)  # eight values are width bytes
    eights.ravel()[: len(values)] = values
    eights <<= np.arange(8, dtype=np.uint64) % U64(4) * U64(width)
    lo, hi = np.bitwise_or.reduce(eights[:, :4], axis=1), np.bitwise_or.reduce(eights[:, 4:], axis=1)
    words = np.stack([lo | (hi << U64(4 * width)), hi >> U64(64 - 4 * width)] if width < 16 else [lo, hi], axis=1)
    return words.view(np.uint8)[:, :width].tobytes()[: -(-len(values) * width // 8)]


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width > 16:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * width).reshape(n, width)
        return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)
    eights = -(-n // 8)
    words = np.zeros((eights, 16), np.uint8)
    words[:, :width] = np.frombuffer(raw.ljust(eights * width, b"\0"), np.uint8).reshape(eights, width)
    low, high = words.view(np.uint64).T
    hi = (low >> U64(4 * width)) | (high << U64(64 - 4 * width)) if width < 16 else high
    four = np.stack([low, hi], axis=1)[:, :, None] >> (np.arange(4, dtype=np.uint64) * U64(width))
    return (four.ravel()[:n] & U64((1 << width) - 1)).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Rows of 1 to BLOCK ids below 2**32 each, as many in all of them; blocks of one width are packed together."""
    m, n = ids.shape
    low = ids.min(1)
    rest = ids - low[:, None]
    at = max(0, -(-n * PERCENT // 100) - 1)
    widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]  # bit lengths
    high = (rest.astype(U64) >> widths.astype(U64)[:, None]).astype("<u4")
    block, place = np.nonzero(high)
    cut = np.searchsorted(block, np.arange(m + 1)).tolist()
    places, highs = place.astype("<u2").tobytes(), high[block, place].tobytes()
    packed: list[bytes] = [b""] * m
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        if n % 8:
            for k in own.tolist():
                packed[k] = _pack(rest[k] & np.uint32((1 << w) - 1), w)
        else:  # each block ends with a byte
            raw, size = _pack((rest[own] & np.uint32((1 << w) - 1)).ravel(), w), n * w // 8
            for i, k in enumerate(own.tolist()):
                packed[k] = raw[i * size : (i + 1) * size]
    heads = zip(low.tolist(), widths.tolist(), packed, cut, cut[1:])
    return [_BLOCK.pack(least, n, w, 0, y - x) + bits + places[2 * x : 2 * y] + highs[4 * x : 4 * y] for least, w, bits, x, y in heads]


def encode_block(ids: np.ndarray) -> bytes:
    """One to BLOCK ids below 2**32."""
    return encode_blocks(ids[None, :])[0]


def decode_blocks(raw: bytes, starts: list[int]) -> list[np.ndarray]:
    """The ids of each block that begins at one of starts; blocks of one width and size are unpacked together."""
    heads = [_BLOCK.unpack_from(raw, at) for at in starts]
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, width, _, _) in enumerate(heads):
        alike.setdefault((n, width), []).append(k)
    out: list = [None] * len(starts)
    for (n, width), own in alike.items():
        size = -(-n * width // 8)
        parts = [raw[starts[k] + _BLOCK.size : starts[k] + _BLOCK.size + size] for k in own]
        flat = _unpack(b"".join(parts), n * len(own), width) if not n % 8 else np.concatenate([_unpack(x, n, width) for x in parts])
        values = flat.reshape(len(own), n)
        for i, k in enumerate(own):
            exceptions = heads[k][4]
            if exceptions:
                at = starts[k] + _BLOCK.size + size
                values[i, np.frombuffer(raw, "<u2", exceptions, at)] += (np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions).astype(U64) << U64(width)).astype(np.uint32)
            out[k] = values[i]
        values += np.array([heads[k][0] for k in own], np.uint32)[:, None]
    return out


def decode_block(raw: bytes) -> np.ndarray:
    return decode_blocks(raw, [0])[0]


class Writer:
    """Takes documents in order; holds packed blocks and the index, not the ids."""

    def __init__(self) -> None:
        self.blocks: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []
        self.left: list[np.ndarray] = []
        self.n_left = self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n += len(ids)
        self.n_left += len(ids)
        self.left.append(ids)
        if self.n_left >= AT_ONCE * BLOCK:
            self._encode()

    def _encode(self) -> None:
        ids = np.concatenate(self.left).astype(np.uint32, copy=False) if self.left else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        for a in range(0, whole, AT_ONCE * BLOCK):
            self.blocks += encode_blocks(ids[a : min(whole, a + AT_ONCE * BLOCK)].reshape(-1, BLOCK))
        self.left, self.n_left = [ids[whole:]], len(ids) - whole

    def finish(self) -> bytes:
        self._encode()
        if self.n_left:
            self.blocks.append(encode_block(self.left[0]))
            self.left, self.n_left = [], 0
        starts = np.zeros(len(self.blocks) + 1, "<u8")
        np.cumsum([len(b) for b in self.blocks], out=starts[1:])
        ids = np.array([0 if i is None else i for i, _ in self.docs], "<i8")
        lengths = np.array([n for _, n in self.docs], "<u8")
        nulls = np.array([i is None for i, _ in self.docs], np.uint8)
        head = _HEAD.pack(MAGIC, len(self.blocks), len(self.docs), self.n)
        return head + starts.tobytes() + ids.tobytes() + lengths.tobytes() + nulls.tobytes() + b"".join(self.blocks)


class Reader:
    """A file's bytes; ids(a, b) decodes only the blocks that hold ids a to b - 1."""

    def __init__(self, raw: bytes) -> None:
        magic, blocks, docs, self.n = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.starts = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        ids = np.frombuffer(raw, "<i8", docs, at)
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
        nulls = np.frombuffer(raw, np.uint8, docs, at + 16 * docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, nulls)]
        self.body, self.raw = at + 17 * docs, raw

    def blocks(self, a: int, b: int) -> list[np.ndarray]:
        return decode_blocks(self.raw, (self.body + self.starts[a:b]).tolist())

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        first = a // BLOCK
        return np.concatenate(self.blocks(first, -(-b // BLOCK)))[a - first * BLOCK : b - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), in order, AT_ONCE blocks and a document in memory at a time."""
        have, next_block, used, at = np.zeros(0, np.uint32), 0, 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            if len(have) - used < n:
                parts, size = [have[used:]], len(have) - used
                while size < n:
                    parts += self.blocks(next_block, min(next_block + AT_ONCE, len(self.starts) - 1))
                    next_block += AT_ONCE
                    size = sum(map(len, parts))
                have, used = np.concatenate(parts), 0
            yield doc_id, at, have[used : used + n]
            used, at = used + n, at + n


class Encoder:
    """Whole texts to ids by the tokenizers library, word by word where that is surely the same.

    A tokenizer that lower-cases, drops white space, splits by the known pattern and works inside pieces gives each
    piece the same ids wherever it stands. Texts of Latin-1 characters without special tokens are split here and their
    pieces looked up; pieces not met yet go to the library. All other texts, and all texts of tokenizers of another
    make, go to the library whole. The memory of pieces is emptied when it has MEMORY of them."""

    MEMORY = 1_200_000
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    _piece = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")
    _plain = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*\Z")

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = normal == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": self.PATTERN} and split.get("behavior") == "Removed"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.by_piece = self.by_piece and bool(suffix)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def pieces(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each of many pieces: encoded in one text between spaces, told apart by their last ids."""
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids = self.whole([" ".join(part)])[0]
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * cut).tolist()
                yield from (raw[x:y] for x, y in zip([0, *ends], ends))
            else:
                yield from (x.tobytes() for x in self.whole(part))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.MEMORY:
            self.known.clear()
        out: list = [None] * len(texts)
        pieces: dict[int, list[str]] = {}
        new: set[str] = set()
        for i, t in enumerate(texts):
            if self.by_piece and self._plain.match(t) and not any(s in t for s in self.special):
                found = pieces[i] = self._piece.findall(t.lower())
                new.update(set(found).difference(self.known))
        if new:
            words = sorted(new)
            self.known.update(zip(words, self.pieces(words)))
        rest = [i for i in range(len(texts)) if i not in pieces]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        known = self.known
        for i, found in pieces.items():
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4")
        return out


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(folder: str, name: str, raw: bytes) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    import uuid

    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(raw)
    system.move(part, f"{path}/{name}")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, rows_per_bucket: int = 4096) -> DataFrame:
    """Encode docs (doc_id, text) into files in folder, in ascending order of doc_id. Lazily: the manifest (bucket,
    piece, name, n_docs, n_ids), to be written by the caller, is what makes the files."""
    fs_, path = fs.FileSystem.from_uri(folder)
    fs_.create_dir(path, recursive=True)
    bounds = boundaries(docs, rows_per_bucket)
    rows = docs.select(bucket(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "text")
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, piece, writer = _encoder(tokenizer), None, 0, Writer()

        def finish() -> Iterator[pa.RecordBatch]:
            if now is not None:
                name = f"part-{now:06d}-{piece:06d}.mft"
                _store(folder, name, writer.finish())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int32()), (piece, pa.int32()), (name, pa.string()), (len(writer.docs), pa.int64()), (writer.n, pa.int64()))], names=["bucket", "piece", "name", "n_docs", "n_ids"])

        end = np.array([end_id], "<u4")
        for batch in batches:
            for a in range(0, len(batch), 256):
                b, ids, texts = (c.slice(a, 256).to_pylist() for c in batch.columns)
                for k, i, e in zip(b, ids, encoder.encode([t or "" for t in texts])):
                    if k != now:
                        yield from finish()
                        now, piece, writer = k, 0, Writer()
                    elif writer.n >= IDS_PER_FILE:
                        yield from finish()
                        piece, writer = piece + 1, Writer()
                    writer.add(i, np.concatenate([e, end]))
        yield from finish()

    return rows.mapInArrow(run, "bucket int, piece int, name string, n_docs long, n_ids long")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("bucket", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over files, not documents
    files = manifest.withColumn("before", before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{path}/{name}") as f:
                    reader = Reader(f.read())
                rows = [(i, at + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, s, ids in reader.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    count = max(1, min(manifest.count(), 4096))
    return files.select("name", "before").repartition(count).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
