"""Lossless codecs of float series, for values that travel as bytes: XOR of neighbours, and decimals as integers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Bits:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value, self.n = self.value << n | v & ((1 << n) - 1), self.n + n

    def done(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def xor_encode(values: list[float]) -> bytes:
    """Each value's bits against the one before: 0 if equal, else the bits between the zeros, in the last window of
    zeros where that holds them."""
    out, before, lead, trail = _Bits(), 0, 65, 0
    for i, x in enumerate(values):
        bits = struct.unpack(">Q", struct.pack(">d", x))[0]
        if not i:
            out.put(bits, 64)
        else:
            d = bits ^ before
            if not d:
                out.put(0, 1)
            else:
                z, t = min(31, 64 - d.bit_length()), (d & -d).bit_length() - 1
                if z >= lead and t >= trail and lead <= 64:
                    out.put(0b10, 2)
                    out.put(d >> trail, 64 - lead - trail)
                else:
                    lead, trail = z, t
                    out.put(0b11, 2)
                    out.put(lead, 5)
                    out.put(64 - lead - trail - 1, 6)
                    out.put(d >> trail, 64 - lead - trail)
        before = bits
    return struct.pack(">I", len(values)) + out.done()


def xor_decode(raw: bytes) -> list[float]:
    n = struct.unpack(">I", raw[:4])[0]
    bits, at = int.from_bytes(raw[4:], "big"), 8 * (len(raw) - 4)

    def take(k: int) -> int:
        nonlocal at
        at -= k
        return bits >> at & ((1 << k) - 1)

    out, before, lead, trail = [], 0, 0, 0
    for i in range(n):
        if not i:
            before = take(64)
        elif take(1):
            if take(1):
                lead = take(5)
                trail = 64 - lead - (take(6) + 1)
            before ^= take(64 - lead - trail) << trail
        out.append(struct.unpack(">d", struct.pack(">Q", before))[0])
    return out


def decimal_encode(values: list[float]) -> bytes:
    """Values that are short decimals as integers at one power of ten, packed from their minimum at one width; others
    as they are, by place."""
    best = None
    for e in range(0, 15):
        digits, odd = [], []
        for i, x in enumerate(values):
            k = round(x * 10**e) if x == x and abs(x) < 1e15 else None
            if k is None or abs(k) >= 1 << 52 or struct.pack("<d", k / 10**e) != struct.pack("<d", x):
                odd.append((i, x))
                digits.append(None)
            else:
                digits.append(k)
        kept = [k for k in digits if k is not None]
        width = (max(kept) - min(kept)).bit_length() if kept else 0
        size = width * len(values) + 96 * len(odd)
        if best is None or size < best[0]:
            best = (size, e, digits, odd, width, min(kept) if kept else 0)
    _, e, digits, odd, width, low = best or (0, 0, [], [], 0, 0)
    bits = _Bits()
    for k in digits:
        bits.put(0 if k is None else k - low, width)
    return struct.pack(">IBBqI", len(values), e, width, low, len(odd)) + b"".join(struct.pack(">Id", i, x) for i, x in odd) + bits.done()


def decimal_decode(raw: bytes) -> list[float]:
    n, e, width, low, odd = struct.unpack_from(">IBBqI", raw)
    at = struct.calcsize(">IBBqI")
    others = [struct.unpack_from(">Id", raw, at + 12 * i) for i in range(odd)]
    body = raw[at + 12 * odd :]
    bits, left = int.from_bytes(body, "big"), 8 * len(body)
    out = [((bits >> left - width * (i + 1) & ((1 << width) - 1)) + low) / 10**e for i in range(n)]
    for i, x in others:
        out[i] = x
    return out


@F.pandas_udf(T.BinaryType())
def compress_series(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(lambda v: None if v is None else xor_encode([float(x) for x in v]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def expand_series(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in raw:
        yield s.map(lambda b: None if b is None else xor_decode(bytes(b)))
