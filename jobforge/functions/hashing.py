"""Hashes with fixed definitions: FNV-1a, seeded minwise families, band keys, name-based identifiers, signature codecs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash definitions.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
EMPTY = 0xFFFFFFFF
#: Of the values of a batch so many, the longest ones, are hashed one at a time past the others' ends.
ONE_BY_ONE = 32


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long; null for null."""
    return _fnv_udf()(F.encode(c, "UTF-8"))


@lru_cache(maxsize=1)
def _fnv_udf():
    def hashed(b: pa.Array) -> pa.Array:
        return pa.array(fnv_batch(b).astype(np.int64), pa.int64(), mask=b.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(hashed, "long")


def fnv_batch(b: pa.Array) -> np.ndarray:
    """FNV-1a of each value of a binary array, the longest first, a byte of all values that have one at a time; what a null gets means nothing."""
    h, b = np.full(len(b), FNV_OFFSET, np.uint32), b.cast(pa.large_binary())
    _, ends, data = b.buffers()
    if data is None or not len(b):
        return h
    at = np.frombuffer(ends, np.int64)[b.offset : b.offset + len(b) + 1]
    data = np.frombuffer(data, np.uint8)
    lens = np.diff(at)
    order = np.argsort(-lens, kind="stable")
    start, own, prime = at[:-1][order], np.full(len(b), FNV_OFFSET, np.uint32), np.uint32(FNV_PRIME)
    # values longer than j, for each j up to where so few are left that one at a time is faster
    few = min(ONE_BY_ONE, len(b))
    steps = int(lens[order[few]]) if len(b) > few else 0
    left = len(b) - np.searchsorted(np.sort(lens), np.arange(steps), side="right")
    for j, n in enumerate(left.tolist()):
        part = own[:n]
        part ^= data[start[:n] + j]
        part *= prime
    for i in range(few):
        a, x = int(start[i]), int(own[i])
        for v in data[a + steps : a + int(lens[order[i]])].tobytes():
            x = (x ^ v) * FNV_PRIME & MASK
        own[i] = x
    h[order] = own
    return h


def seeded_draws(seed: int):
    """The subtractive generator of Knuth with lag 55 and 21, as frameworks seed it; yields samples below 2**31 - 1."""
    big, s = 2147483647, [0] * 56
    mj = 161803398 - abs(seed)
    s[55], mk = mj, 1
    for i in range(1, 55):
        ii = 21 * i % 55
        s[ii] = mk
        mk = mj - mk
        if mk < 0:
            mk += big
        mj = s[ii]
    for _ in range(4):
        for i in range(1, 56):
            s[i] -= s[1 + (i + 30) % 55]
            if s[i] < 0:
                s[i] += big
    a, b = 0, 21
    while True:
        a, b = a % 55 + 1, b % 55 + 1
        v = s[a] - s[b]
        if v == big:
            v -= 1
        if v < 0:
            v += big
        s[a] = v
        yield v


def family(count: int = 100, universe: int = 1_000_000, seed: int = 1000) -> tuple[np.ndarray, int]:
    """(multiplier masks, kept bits) of ``count`` functions. The second parameter of each is drawn but can't reach the kept bits."""
    bits = int(np.log2(universe)) + 1
    draws, out = seeded_draws(seed), []
    limit = 1 << (32 - bits)
    for _ in range(count):
        a = next(draws)
        while a % 2 == 0:
            a = next(draws)
        while int(next(draws) * (1.0 / 2147483647) * limit) <= 0:
            pass
        out.append(a)
    return np.array(out, np.uint32), bits


def shingle_hashes(text: str, k: int = 5) -> np.ndarray:
    """FNV-1a of every substring of k characters (UTF-8 bytes), not made distinct."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(cp) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    lead = np.select([size == 1, size == 2, size == 3], [cp, 0xC0 | cp >> 6, 0xE0 | cp >> 12], 0xF0 | cp >> 18)
    rest = [0x80 | cp >> 6 * j & 0x3F for j in range(3)]
    h = np.full(n, FNV_OFFSET, np.uint32)
    prime = np.uint32(FNV_PRIME)
    for at in range(k):
        w = slice(at, at + n)
        h = (h ^ lead[w].astype(np.uint32)) * prime
        for j in (2, 1, 0):
            more = size[w] > j + 1
            h = np.where(more, (h ^ rest[j][w].astype(np.uint32)) * prime, h)
    return h


def signature(hashes: np.ndarray, masks: np.ndarray, bits: int) -> np.ndarray:
    """Minwise signature of hashed shingles; all ones for none."""
    if not len(hashes):
        return np.full(len(masks), EMPTY, np.uint32)
    x = (np.uint32(FNV_OFFSET) ^ hashes) * np.uint32(FNV_PRIME)
    # repeated shingles don't change a minimum; the shift keeps order, so it follows it
    return ((x[None, :] ^ masks[:, None]) * np.uint32(FNV_PRIME)).min(axis=1) >> np.uint32(32 - bits)


def band_keys(sig: np.ndarray, bands: int) -> list[str]:
    """Per band eight hex digits: FNV-1a over its 32-bit words."""
    rows, out = len(sig) // bands, []
    for b in range(bands):
        h = FNV_OFFSET
        for v in sig[b * rows : (b + 1) * rows].tolist():
            h = (h ^ v) * FNV_PRIME & MASK
        out.append(f"{h:08X}")
    return out


def pack_signature(sig: list[int]) -> bytes:
    """32-bit words, little-endian."""
    return np.array(sig, "<u4").tobytes()


def unpack_signature(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def name_guid(namespace_hex_le: str, name: Column) -> Column:
    """A guid from a namespace (its bytes in mixed-endian order, as hex) and a name: SHA-1, version 5 at byte 7 and variant at byte 8 of the mixed-endian layout."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex_le)), F.encode(name, "UTF-8"))), 1, 32)
    byte = lambda i: F.substring(digest, 2 * i + 1, 2)
    number = lambda c: F.conv(c, 16, 10).cast("int")
    b7 = F.lower(F.lpad(F.hex(number(byte(7)).bitwiseAND(F.lit(0x0F)).bitwiseOR(F.lit(0x50))), 2, "0"))
    b8 = F.lower(F.lpad(F.hex(number(byte(8)).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))), 2, "0"))
    return F.concat(byte(3), byte(2), byte(1), byte(0), F.lit("-"), byte(5), byte(4), F.lit("-"), b7, byte(6), F.lit("-"), b8, byte(9), F.lit("-"), *(byte(i) for i in range(10, 16)))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures; 0 where one is empty or lengths differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), same / F.size(a)).otherwise(F.lit(0.0))
