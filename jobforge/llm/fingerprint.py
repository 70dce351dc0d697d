"""Text fingerprints in numpy: shingle sketches and tokens of many texts at once.

Two texts are similar when the sets of their distinct substrings of five characters, after lower-casing and folding everything but
letters and digits to single spaces, have an intersection of at least 0.7 of their union. Nothing here decides that; ``similar`` does, exactly.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE, THRESHOLD = 5, 0.7
#: Texts are fingerprinted in groups of at most this many characters (a longer text is a group of its own).
GROUP_CHARS = 100_000
BINS = 128
U = np.uint64


_WORDS: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    """Whether a code point is a letter or a digit, for all of them (1.1 MB, made once a process)."""
    if not _WORDS:
        _WORDS.append(np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000))
    return _WORDS[0]


def normalised(texts: list[str | None]) -> list[str]:
    """Lower-cased, every run of other characters than letters and digits one space, trimmed; empty for null."""
    out: list[str] = []
    word = _is_word()
    lower = [(t or "").lower() for t in texts]
    for a, b in groups(lower):
        cp = np.frombuffer(("\0".join(t.replace("\0", " ") for t in lower[a:b]) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        keep = word[cp]
        end = cp == 0
        # of a run of other characters the last one stays, as a space; the ends of texts stay as they are
        nxt = np.concatenate((keep[1:], [False]))
        gap = ~keep & ~end & nxt
        made = np.where(keep | end, cp, 32)[keep | end | gap]
        out += [t.lstrip(" ") for t in made.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\0")[:-1]]
    return out


def tid(text: str) -> bytes:
    """A normalised text's hash."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def usable(ids, texts: list[str]):
    """The ids (an Arrow array or a list of them) and texts that have a shingle."""
    keep = [len(t) >= SHINGLE for t in texts]
    mask = pa.array(keep, pa.bool_())
    many = isinstance(ids, list)
    left = [c.filter(mask) for c in (ids if many else [ids])]
    return left if many else left[0], [t for t, k in zip(texts, keep, strict=True) if k]


def pack(text: str) -> bytes:
    """A normalised text, compressed for shuffles."""
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def unpack(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def jaccard(a: str, b: str) -> float:
    """Of the shingle sets; 0 where neither text has a shingle."""
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two packed texts are similar: the exact check."""
    return pd.Series([jaccard(unpack(x), unpack(y)) >= THRESHOLD for x, y in zip(a, b, strict=True)], dtype=bool)


similar = F.pandas_udf(_similar, T.BooleanType())


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values (multiply and xor-shift)."""
    x = (x ^ U(seed)) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def groups(texts: list[str]):
    """Slices of consecutive texts of bounded total length."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size + len(t) > GROUP_CHARS and i > start:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a 0; the text each belongs to; its place in the text."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), lens)
    return cp, doc, np.arange(len(cp)) - np.repeat(np.cumsum(lens) - lens, lens)


def minima(texts: list[str], seeds: tuple[int, ...]) -> np.ndarray:
    """One-permutation minwise values of the shingle sets: (len(seeds), texts, BINS) of uint32; all ones where a bin is empty."""
    out = np.full((len(seeds), len(texts) * BINS), 0xFFFFFFFF, np.uint32)
    cp, doc, at = _flat(texts)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    n = len(cp) - SHINGLE + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = h * U(0x100000001B3) + cp[k : k + n]
        ok = at[:n] + SHINGLE <= lens[doc[:n]]
        h, d = h[ok], doc[:n][ok]
        for i, seed in enumerate(seeds):
            v = mix(h, seed)
            np.minimum.at(out[i], d * BINS + (v >> U(57)).astype(np.int64), (v & U(0xFFFFFFFF)).astype(np.uint32))
    return out.reshape(len(seeds), len(texts), BINS)


def bits64(values: np.ndarray) -> np.ndarray:
    """The lowest bits of 64 minima a text as one signed 64-bit number: texts agree in a bit with probability (1 + J) / 2."""
    return np.ascontiguousarray(np.packbits((values & 1).astype(np.uint8), axis=1)).view(">i8").ravel().astype(np.int64)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, s0, s1, s2) of normalised texts: 64 one-byte minima for segments, and three independent 64-bit sketches."""
    parts = []
    for a, b in groups(texts):
        m = minima(texts[a:b], (0x51ED270B, 0x2545F491))
        parts.append(((m[0][:, :64] & 0xFF).astype(np.uint8), bits64(m[0][:, 64:]), bits64(m[1][:, :64]), bits64(m[1][:, 64:])))
    if not parts:
        return np.zeros((0, 64), np.uint8), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 44-bit hash) of every text's distinct shingles."""
    cp, doc, at = _flat(texts)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    n = max(len(cp) - SHINGLE + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * U(0x100000001B3) + cp[k : k + n]
    ok = at[:n] + SHINGLE <= lens[doc[:n]]
    h, d = mix(h[ok]), doc[:n][ok]
    # texts are told apart by the high bits, shingles of a text by the other 44
    u = np.sort((d.astype(np.uint64) << U(44)) | (h >> U(20)))
    u = u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) else u
    return (u >> U(44)).astype(np.int64), u & U((1 << 44) - 1)


def sizes(texts: list[str]) -> np.ndarray:
    """Number of distinct shingles of every text (by 64-bit hash)."""
    out = [np.bincount(_distinct(texts[a:b])[0], minlength=b - a) for a, b in groups(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: Tokens of a text, minima that make up one, and tokens that similar texts share at least, but for the probability stated in ``tokens``.
TOKENS, JOINED, SHARED = 40, 4, 2
PREFIX = TOKENS - SHARED + 1
COUNTERS = 1 << 20


def _filled(values: np.ndarray) -> np.ndarray:
    """Minima with each empty bin taking the next filled one's value, altered by the distance, so that texts of few shingles have tokens of their own."""
    out = values.astype(np.uint64)
    empty = values == 0xFFFFFFFF
    rows = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    if len(rows):
        v, e = out[rows], empty[rows]
        near, far = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for k in [*range(v.shape[1] - 1, -1, -1)] * 2:  # the second turn goes round the end
            own = e[:, k]
            far = np.where(own, far + U(1), U(0))
            near = np.where(own, near, v[:, k])
            v[:, k] = np.where(own, near + (far << U(32)), v[:, k])
        out[rows] = v
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, s0, s1, s2) of normalised texts: TOKENS 32-bit tokens each, and three 64-bit sketches from other minima than the tokens'.

    A token is the hash of its number and JOINED minima of the shingle set, so two texts with Jaccard J have a given token in common with probability
    J ** JOINED. At 0.7 they share fewer than SHARED of them with probability 0.0002, at 0.75 with 0.000004, wherever the edits lie."""
    parts = []
    for a, b in groups(texts):
        m = minima(texts[a:b], (0x51ED270B, 0x2545F491, 0x1B873593))
        v = np.concatenate((_filled(m[2]), _filled(m[0][:, :64])), axis=1)[:, : TOKENS * JOINED].reshape(b - a, TOKENS, JOINED)
        h = np.broadcast_to(np.arange(1, TOKENS + 1, dtype=np.uint64) << U(40), v.shape[:2])
        for k in range(JOINED):
            h = mix(h ^ v[:, :, k], 0x7F4A7C15 + k)
        parts.append(((h >> U(32)).astype(np.uint32), bits64(m[0][:, 64:]), bits64(m[1][:, :64]), bits64(m[1][:, 64:])))
    if not parts:
        return np.zeros((0, TOKENS), np.uint32), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def prefixes(tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Of each text's tokens the PREFIX rarest by the counters, ties by token: two texts that share SHARED tokens or more have one of them in both prefixes."""
    rank = (df[(tokens & np.uint32(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << U(32)) | tokens
    return np.take_along_axis(tokens, np.argsort(rank, axis=1)[:, :PREFIX], axis=1)
