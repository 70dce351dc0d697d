"""Byte-level byte-pair encoding over a segment tree, for whole columns of texts.

The tree stands over the byte positions of one piece; a leaf holds the rank of the pair that its live token and the next live one make, an inner
node the smaller of its children, leftmost on ties. A merge takes the root, joins two tokens, and updates the leaves of the token, of its live left
neighbour and of the token that went: O(log n) each, so a run of any length costs O(n log n).
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import table

#: Where the public vocabularies are; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"
#: The public pattern that parts a text before merging. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps of each of its two tables before it starts them anew; results don't depend on it.
KEPT = 200_000
LONG = 200
NONE = 1 << 62


def load_ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    """Token bytes and their ids (0.8 MB, fixed by the vocabulary)."""
    with Path(folder, name).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # of the token that begins at a position
    prev = list(range(-1, n - 1))  # where the live token before begins
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a < b else b
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    live = [True] * n
    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = e = end[j]
        live[j] = False
        put(j, NONE)
        if e < n:
            prev[e] = i
            r = get(piece[i : end[e]])
            put(i, NONE if r is None else r << 32 | i)
        else:
            put(i, NONE)
        p = prev[i]
        if p >= 0:
            r = get(piece[p:e])
            put(p, NONE if r is None else r << 32 | p)
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Encoder(dict):
    """Packed ids (little-endian 32-bit) of a text's stretches, each looked up or made once.

    A blank between two characters that are not white space always begins a piece, so the stretch from one such blank to the next can be encoded
    by itself. Stretches that touch other white space are joined again before."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pieces, self.split = ranks, {}, regex.compile(PATTERN).findall

    def __missing__(self, stretch: str) -> bytes:
        out = []
        for piece in self.split(stretch):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<i4").tobytes()
                if len(piece) <= LONG:
                    self.pieces[piece] = ids
            out.append(ids)
        packed = b"".join(out)
        if len(stretch) <= LONG:
            self[stretch] = packed
        return packed

    def tidy(self) -> None:
        """Bound the memory."""
        if len(self) > KEPT:
            self.clear()
        if len(self.pieces) > KEPT:
            self.pieces.clear()

    def packed(self, text: str) -> bytes:
        """The ids of a text."""
        if not text:
            return b""
        parts = text.split(" ")
        if len(parts) == 1:
            return self[text]
        lead = [parts[0]] if parts[0] else []
        stretches = lead + [" " + p for p in parts[1:]]
        if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
            return b"".join(map(self.__getitem__, _joined(parts)))
        return b"".join(map(self.__getitem__, stretches))


def _joined(parts: list[str]) -> list[str]:
    """Stretches again, cut only at blanks with other than white space on both sides."""
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """(id, ids), or with ``counts_only`` (id, n_tokens, n of the text's characters aside): one row for each row of ``df``.

    Null and empty texts give an empty array (0 tokens). Strings of special tokens are ordinary text. Whole texts are encoded, of any length;
    repeated rows give repeated rows, further columns are left out, an empty table gives no rows."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(folder))  # fixed by the vocabulary

    def batches(it):
        enc = Encoder(ranks.value)
        for b in it:
            packed = []
            for t in b.column("text").to_pylist():
                packed.append(enc.packed(t) if t else b"")
                enc.tidy()
            lens = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            if counts_only:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lens)], ["doc_id", "n_tokens"])
            else:
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), flat)], ["doc_id", "ids"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(batches, f"doc_id {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids: the token ids of every document."""
    return encode_column(table(spark, sf_dir, "documents"))
