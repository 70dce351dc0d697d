"""Personal information in free text: character tags by a bidirectional LSTM with CRF transitions, then typed placeholders.

Texts are cut into overlapping windows; where windows overlap, a character's scores are averaged with weights that fall towards a window's edge, and one Viterbi
pass over the whole text reconciles them. Every window is scored.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import table
from jobforge.llm import charlstm as net

KINDS = ("email", "phone", "identity", "address", "name")
TAGS = ("", *KINDS)
WINDOW, STRIDE, AT_ONCE = 160, 128, 1024
MODEL = Path(__file__).with_name("pii_model.npz")

#: What a span must have at least to be of its kind: the exact check after the model.
CHECKS = {
    "email": re.compile(r"\w.*?(?:@|\bat\b|собака).*?\w", re.I | re.S),
    "phone": re.compile(r"(?:\d\D*){9}|^\d{3}[-– ]\d{2}[-– ]\d{2}$"),
    "identity": re.compile(r"(?:\d\D*){6}"),
    "address": re.compile(r"[^\W\d_]{2}.*\d|\d.*[^\W\d_]{2}", re.S),
    "name": re.compile(r"[^\W\d_]{2}[\w\-]*[\s.]+[^\W\d_]|[^\W\d_]\.\s?[^\W\d_]"),
}


def _inside_word(t: str, a: int, b: int) -> bool:
    """Whether a span begins or ends amid a word."""
    return (a > 0 and t[a - 1].isalpha() and t[a].isalpha()) or (b < len(t) and t[b].isalpha() and t[b - 1].isalpha())


class Tagger:
    """Spans of many texts at once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.m = net.folded(model)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) per text, in order; positions are characters."""
        out: list[list] = [[] for _ in texts]
        for chunk in _by_size([i for i, t in enumerate(texts) if t], [len(t) for t in texts]):
            for i, s in zip(chunk, self._chunk([texts[i] for i in chunk]), strict=True):
                out[i] = s
        return out

    def _chunk(self, texts: list[str]) -> list[list]:
        lens = [len(t) for t in texts]
        base = np.concatenate(([0], np.cumsum([n + WINDOW for n in lens])))
        flat = np.zeros(base[-1], np.int16)
        for t, b in zip(texts, base, strict=False):
            flat[b : b + len(t)] = net.classes(t)
        k = len(TAGS)
        score, weight = np.zeros((len(flat), k), np.float32), np.zeros(len(flat), np.float32)
        ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
        starts = np.concatenate([np.arange(b, b + max(n - (WINDOW - STRIDE), 1), STRIDE) for n, b in zip(lens, base, strict=False)])
        for own in np.array_split(starts, -(-len(starts) // AT_ONCE)):
            e = net.emissions(self.m, np.ascontiguousarray(flat[own[:, None] + np.arange(WINDOW)].T))
            for a, w in zip(own.tolist(), e.transpose(1, 0, 2) * ramp[None, :, None], strict=True):  # adding a slice at a time is faster than by index
                score[a : a + WINDOW] += w
                weight[a : a + WINDOW] += ramp
        seen = weight > 0
        score[seen] /= weight[seen, None]
        tags = np.zeros(len(flat), np.int8)
        for at, row in self._uncertain(score, ~seen):
            tags[at] = row
        tags = [tags[b : b + n] for b, n in zip(base, lens, strict=False)]
        out = []
        for t, row in zip(texts, tags, strict=True):
            edges = np.flatnonzero(np.diff(row, prepend=0, append=0))
            spans = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if row[a] and CHECKS[TAGS[row[a]]].search(t[a:b]) and not (TAGS[row[a]] == "name" and _inside_word(t, a, b)):
                    spans.append((int(a), int(b), TAGS[row[a]]))
            out.append(spans)
        return out


    def _uncertain(self, score: np.ndarray, sure: np.ndarray):
        """The stretches whose best tags aren't plain from the scores alone, decoded: (positions, tags).

        Where "none" leads every tag by more than that tag can gain from its two transitions, exchanging it for "none" improves any path, so
        the best path has "none" there; the pass over the whole text falls into independent stretches between such places, exactly."""
        tr = self.m["trans"]
        gain = (tr - tr[:, :1]).max(axis=0) + (tr - tr[:1]).max(axis=1)
        plain = np.ones(len(score), bool)
        for k in range(1, score.shape[1]):
            plain &= score[:, 0] - score[:, k] > gain[k]
        sure = sure | plain
        sure[-1] = True
        edge = np.flatnonzero(np.diff(sure.astype(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]
        order = np.argsort(last - first)
        k = score.shape[1]
        for a in range(0, len(order), AT_ONCE):
            own = order[a : a + AT_ONCE]
            lens = last[own] - first[own]
            at = first[own, None] + np.arange(lens.max())
            inside = np.arange(lens.max()) < lens[:, None]
            none = np.array([[0.0] + [-1e4] * (k - 1)], np.float32)
            e = np.where(inside[:, :, None], score[np.minimum(at, len(score) - 1)], none)
            e = np.concatenate([np.broadcast_to(none, (len(own), 1, k)), e, np.broadcast_to(none, (len(own), 1, k))], axis=1)
            got = net.viterbi(np.ascontiguousarray(e.transpose(1, 0, 2)), tr).T[:, 1:-1]
            yield at[inside], got[inside]


def _by_size(todo: list[int], lens: list[int], chars: int = 600_000):
    """Texts of like length together, so that little is padding; at most so many characters, padded, in a group."""
    group: list[int] = []
    for i in sorted(todo, key=lambda i: lens[i]):
        if group and lens[i] * (len(group) + 1) > chars:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in the place of each span."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def tag_column(df: DataFrame, id_col: str = "id", text_col: str = "text", model: str | Path = MODEL, texts: bool = False) -> DataFrame:
    """(id, spans array<struct<start,end,kind>>), and with ``texts`` also the redacted text, for each row of ``df``.

    Null texts stay null, empty ones empty, both without spans. Texts of any length are read whole. Repeated rows give repeated rows; further
    columns are left out."""
    with np.load(model) as f:
        weights = df.sparkSession.sparkContext.broadcast({k: f[k] for k in f.files})  # under 0.2 MB, fixed by the model

    def batches(it):
        tagger = Tagger(weights.value)
        for b in it:
            own = b.column("text").to_pylist()
            found = tagger.spans([t or "" for t in own])
            spans = pa.array([[{"start": a, "end": e, "kind": k} for a, e, k in s] for s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))
            cols, names = [b.column("id"), spans], ["id", "spans"]
            if texts:
                cols.append(pa.array([None if t is None else redacted(t, s) for t, s in zip(own, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id string, spans array<struct<start:int,end:int,kind:string>>" + (", redacted string" if texts else "")
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: the kinds of personal information in each ad."""
    tagged = tag_column(table(spark, sf_dir, "ads"))
    return tagged.select(F.col("id").alias("ad_id"), F.explode(F.array_distinct(F.col("spans.kind"))).alias("kind"))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_redacted: every ad's text with placeholders, and the number of spans."""
    return tag_column(table(spark, sf_dir, "ads"), texts=True).select(F.col("id").alias("ad_id"), F.col("redacted").alias("text"), F.size("spans").alias("n_spans"))
