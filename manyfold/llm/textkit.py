"""Vectorised work on whole texts inside Arrow batches: chunking, code points, word spans, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_R = 0x9E6C63D0876A9A35  # odd: invertible modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)
#: Texts are worked on in slices of about so many bytes (a longer text is a slice of its own).
SLICE = 1 << 21


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about limit bytes of text each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each begins (one more entry: the end)."""
    texts = pa.concat_arrays([texts])  # drops a slice's offset
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and where each begins (one more entry: the end)."""
    data, _ = utf8(texts)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.asarray(pc.utf8_length(texts)), out=off[1:])
    return np.frombuffer(str(data.tobytes(), "utf-8").encode("utf-32-le"), np.uint32), off


def owners(off: np.ndarray) -> np.ndarray:
    """For each element its text's number."""
    return np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true elements; no run crosses from one text to the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, 2 * len(_pow))
        for name, base in (("_pow", _R), ("_inv", _R_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values, the same wherever the span lies: prefix sums of a polynomial."""
    n = len(values)
    _powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * _pow[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _inv[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.ones(256, bool)
_word[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes: starts, ends and hashes (A-Z lower-cased first, if so wanted)."""
    starts, ends = spans(_word[data], off)
    return starts, ends, span_hashes(_lower[data] if lower else data, starts, ends)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1 for all i on end."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - sizes), sizes)
