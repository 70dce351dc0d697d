"""Abusive, hateful and sexual content: a linear-chain CRF over words, trained at use from judged texts.

Two tags, clean and offending. Moderators judged whole texts, so words are labelled from a distance: within an offending text, a word counts as offending where its
kind (``toxicity_seed``) says it may; only in a text without such words do those count that they, or a pair they make with a neighbour, are found in offending
texts only and in at least two of them (a few hundred judged texts have many harmless words on one side only). Besides
words, their ends and pairs, features are the kinds of a word and of those near it, and half of the fit sees kinds alone, so that forms no judged text has
are known by them. Forward-backward over the whole chain gives each word's marginal; a document's score is its
highest marginal, and the words above THRESHOLD are its offending stretches, given as places in the document as it was read. Disguises (look-alike
and substituted letters, letters set apart, masked letters, invisible marks, accents taken apart) are undone before words are looked at.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import table
from jobforge.llm.toxicity_seed import KINDS, TAILS, kind, squeezed

#: At most so many judged texts are used for fitting (a documented bound; the table has 600).
JUDGED = 20_000
#: Hashed features, words of a block of a chain, words on either side whose kinds count.
FEATURES, STEP, WINDOW = 1 << 18, 64, 4
THRESHOLD = 0.3
#: Share of texts that a round of the fit sees by their words' kinds alone, so that kinds explain what they can.
BLIND = 0.5
#: Letters that look alike, and digits and marks that stand for letters.
TO_CYRILLIC = str.maketrans("aceopxykmhbtunrё0134@", "асеорхукмнвтипге0134@")
LEET_CYRILLIC = str.maketrans("0134689@$6", "оизабваасб")
LEET_LATIN = str.maketrans("0134578@$!", "oieastba$i")
TO_LATIN = str.maketrans("асеорхукмнвт", "aceopxykmhbt")
INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿️̀-ͯ]")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
CONTROL = re.compile(r"<\|\w{1,40}\|>")
APART = re.compile(r"(?<![^\W_])[^\W\d_](?:(?P<s>[ .\-_*]{1,2})[^\W\d_])(?:(?P=s)[^\W\d_]){1,}(?![^\W_])")
WORD = re.compile(r"[^\W_](?:[\w@$*•#!+]*[\w@$*])?")
MASK = re.compile(r"[*•#_+!]")
DRAWN = re.compile(r"([^\W\d_])\1{2,}")


def plain(text: str) -> str:
    """Lower-cased text without markup, invisible marks and letters set apart; letters with accents composed, й kept."""
    if "<" in text:
        text = TAG.sub(" ", CONTROL.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = repaired(text)
        text = unicodedata.normalize("NFKC", text)
        text = INVISIBLE.sub("", text)
    text = text.lower()
    return APART.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)


ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def origins(text: str) -> list[tuple[int, int]] | None:
    """For every character of ``plain(text)`` the range of ``text`` it comes from; None where a text can't be followed (rare compositions)."""
    chars, at = list(text), [(i, i + 1) for i in range(len(text))]

    def replaced(rx, made) -> None:
        nonlocal chars, at
        now, out, where, done = "".join(chars), [], [], 0
        for m in rx.finditer(now):
            a, b = m.span()
            new = made(m)
            out += chars[done:a] + list(new)
            where += at[done:a] + [(at[a][0], at[b - 1][1])] * len(new)
            done = b
        chars, at = out + chars[done:], where + at[done:]

    if "<" in text:
        replaced(CONTROL, lambda m: "")
        replaced(TAG, lambda m: " ")
    if "&" in text:
        replaced(ENTITY, lambda m: html.unescape(m.group()))
    if not "".join(chars).isascii():
        if "Ð" in chars or "Ñ" in chars:
            replaced(_BROKEN, lambda m: repaired(m.group()))
        out, where, i = [], [], 0
        while i < len(chars):  # a character and the marks that combine with it
            j = i + 1
            while j < len(chars) and unicodedata.combining(chars[j]):
                j += 1
            new = unicodedata.normalize("NFKC", "".join(chars[i:j]))
            out += new
            where += [(at[i][0], at[j - 1][1])] * len(new)
            i = j
        chars, at = out, where
        kept = [i for i, c in enumerate(chars) if not INVISIBLE.match(c)]
        chars, at = [chars[i] for i in kept], [at[i] for i in kept]
    low = [(c.lower(), a) for c, a in zip(chars, at, strict=True)]
    chars, at = [c for x, _ in low for c in x], [a for x, a in low for _ in x]
    now, kept, done = "".join(chars), [], 0
    for m in APART.finditer(now):
        kept += [*range(done, m.start()), *(i for i in range(*m.span()) if now[i] not in " .-_*")]
        done = m.end()
    kept += range(done, len(now))
    return [at[i] for i in kept] if "".join(now[i] for i in kept) == plain(text) else None


def places(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Ranges of ``plain(text)`` as ranges of ``text``; of a text that can't be followed, all of it."""
    if not spans:
        return []
    at = origins(text)
    if at is None:
        return [{"start": 0, "end": len(text)}]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]


_CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_BROKEN = re.compile("(?:[\xc2-\xf4][\x80-\xbf" + "".join(map(chr, _CP1252)) + "]+){2,}")


def repaired(text: str) -> str:
    """Text with stretches whose UTF-8 bytes were once read as one-byte characters read again; other text as it is."""
    if "Ð" in text or "Ñ" in text:
        return _BROKEN.sub(lambda m: bytes(_CP1252.get(ord(c), ord(c) & 0xFF) for c in m.group()).decode("utf-8", "ignore"), text)
    return text


@lru_cache(maxsize=200_000)
def word_form(w: str) -> str:
    """One spelling of a word: its letters in one script, substituted digits and marks as letters. Numbers become #."""
    letters = sum(c.isalpha() for c in w)
    if not letters:
        return "#"
    w = DRAWN.sub(r"\1", w)
    if w.isalpha() and (w.isascii() or not re.search("[a-z]", w)):
        return w.replace("ё", "е")
    cyr = len(re.findall("[а-яё]", w))
    lat = len(re.findall("[a-z]", w))
    if cyr and cyr >= lat or cyr and not re.search("[dfgijlnqrsuvwz]", w):
        return w.translate(TO_CYRILLIC).translate(LEET_CYRILLIC) if letters >= 2 else w
    if lat and not cyr:
        return w.translate(LEET_LATIN) if letters >= 2 and not re.fullmatch(r"[a-z]+\d+|\d+[a-z]+", w) else w
    return w.translate(TO_LATIN)


class Words:
    """Splits texts into words and resolves masked ones against the vocabulary of offending words."""

    def __init__(self, lexicon: frozenset[str] = frozenset()):
        self.lexicon, self.masked = lexicon, {}

    def __call__(self, text: str) -> tuple[list[str], list[tuple[int, int]], str]:
        p = plain(text)
        out, at = [], []
        for m in WORD.finditer(p):
            w = m.group()
            out.append(self.unmasked(w) if MASK.search(w) else word_form(w))
            at.append(m.span())
        return out, at, p

    def unmasked(self, w: str) -> str:
        if w not in self.masked:
            rx = re.compile("".join("[^\\W\\d_]" if MASK.fullmatch(c) else re.escape(c) for c in w))
            fits = sorted(x for x in self.lexicon if len(x) == len(w) and rx.fullmatch(x))
            form = word_form(MASK.sub("", w)) if not fits else fits[0]
            if len(self.masked) < 100_000:
                self.masked[w] = form
            return form
        return self.masked[w]


def _hash(s: str) -> int:
    h = 1469598103934665603
    for b in s.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=300_000)
def _unigrams(w: str) -> tuple[tuple[int, ...], int]:
    """Feature numbers of a word by itself, as left and as right neighbour (in that order), and the word's hash."""
    own = [f"w={w}", f"p5={w[:5]}", f"p4={w[:4]}", f"s3={w[-3:]}"]
    return tuple(_hash(f) % FEATURES for f in (*own, f"l={w}", f"r={w}")), _hash(w)


OWN = 4


def _pairs(h: np.ndarray) -> np.ndarray:
    """Feature numbers of each word's pair with the next one."""
    nxt = np.concatenate((h[1:], [0])).astype(np.uint64)
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (nxt + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) % FEATURES


def _kinds(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each word, kinds present among the WINDOW words on either side of it as a 0/1 matrix)."""
    own = np.fromiter((kind(w) for w in words), np.int64, len(words))
    for i in np.flatnonzero(own < 0):  # a word that ends phrases, or has no kind
        own[i] = TAILS[words[i]].get(words[i - 1], 0) if i else 0
        if own[i] and not own[i - 1]:
            own[i - 1] = own[i]
    near = np.zeros((len(words), len(KINDS)))
    for i in np.flatnonzero(own):
        near[max(i - WINDOW, 0) : i, own[i]] = 1
        near[i + 1 : i + 1 + WINDOW, own[i]] = 1
    return own, near


class Scorer:
    """Emission scores of words: sums of feature weights; each word's part is kept once made."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, own: np.ndarray, near: np.ndarray, trans: np.ndarray, words: Words):
        self.w, self.pairs, self.own, self.near, self.trans, self.words, self.kept = weights, pairs, own, near, trans, words, {}

    def part(self, w: str) -> tuple[float, float, float, int]:
        if len(self.kept) > 300_000:
            self.kept.clear()
        f, h = _unigrams(w)
        got = self.kept[w] = (float(self.w[list(f[:OWN])].sum()), float(self.w[f[OWN]]), float(self.w[f[OWN + 1]]), h)
        return got

    def emissions(self, words: list[str]) -> np.ndarray:
        """Advantage of the offending tag for each word."""
        kept = self.kept
        parts = [kept.get(w) or self.part(w) for w in words]
        own, left, right = (np.fromiter((p[i] for p in parts), np.float64, len(parts)) for i in range(3))
        e = own
        e[1:] += left[:-1]
        e[:-1] += right[1:]
        f = _pairs(np.fromiter((p[3] for p in parts), np.uint64, len(parts)))[:-1]
        e[:-1] += self.pairs[f, 0]
        e[1:] += self.pairs[f, 1]
        k, near = _kinds(words)
        if k.any():
            e += self.own[k] + (near * self.near[k]).sum(axis=1)
        else:
            e += self.own[0]
        return e

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Of the offending tag, for each word of each document, over whole chains."""
        return whole_chains(docs, self.trans)


def whole_chains(docs: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Marginals of tag 1 of chains of any length, in blocks of STEP words: each block's product of transitions first, then the messages at its two
    ends along the chain, then all blocks at once. The result is that of the uncut chain."""
    out = [np.zeros(len(e)) for e in docs]
    at = np.array([(i, a) for i, e in enumerate(docs) for a in range(0, len(e), STEP)], np.int64).reshape(-1, 2)
    if not len(at):
        return out
    n = len(at)
    x = np.ones((STEP, n))  # past a chain's end words are left out by ``lens``
    lens = np.array([min(STEP, len(docs[i]) - a) for i, a in at])
    for j, (i, a) in enumerate(at):
        x[: lens[j], j] = np.exp(np.clip(docs[i][a : a + STEP], -50, 50))
    t = np.exp(trans)
    first, last = at[:, 1] == 0, np.concatenate((at[1:, 1] == 0, [True]))
    step = np.where(first[:, None, None], np.eye(2), t)  # the first word of a chain has no transition
    prod = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for s in range(STEP):
        go = s < lens
        m = prod @ (t if s else step)
        m[:, :, 1] *= x[s][:, None]
        m /= m.sum(axis=(1, 2), keepdims=True)
        prod = np.where(go[:, None, None], m, prod)
    start, end = np.ones((n, 2)), np.ones((n, 2))
    place = at[:, 1] // STEP
    for d in range(1, int(place.max()) + 1):  # blocks of one place in their chains at a time
        own = np.flatnonzero(place == d)
        v = (start[own - 1][:, None, :] @ prod[own - 1])[:, 0]
        start[own] = v / v.sum(axis=1, keepdims=True)
    for d in range(int(place.max()) - 1, -1, -1):
        own = np.flatnonzero((place == d) & ~last)
        v = (prod[own + 1] @ end[own + 1][:, :, None])[:, :, 0]
        end[own] = v / v.sum(axis=1, keepdims=True)
    al, v = np.empty((STEP, n, 2)), start
    for s in range(STEP):
        v = v @ t if s else (start[:, None, :] @ step)[:, 0]
        v[:, 1] *= x[s]
        v /= v.sum(axis=1, keepdims=True)
        al[s] = v
    be = end.copy()
    p = np.zeros((STEP, n))
    for s in range(STEP - 1, -1, -1):
        be = np.where((s == lens - 1)[:, None], end, be)
        g = al[s] * be
        p[s] = g[:, 1] / g.sum(axis=1)
        b = be.copy()
        b[:, 1] *= x[s]
        b = b @ t.T
        be = b / b.sum(axis=1, keepdims=True)
    for j, (i, a) in enumerate(at):
        out[i][a : a + lens[j]] = p[: lens[j], j]
    return out


def forward_backward(e: np.ndarray, trans: np.ndarray):
    """Marginals (steps, n) of tag 1 and pair expectations (2, 2) of chains with advantages ``e`` and log transitions; log Z."""
    steps, n = e.shape
    x = np.exp(np.clip(e, -50, 50))
    t = np.exp(trans)
    al, scale = np.empty((steps, n, 2)), np.empty((steps, n))
    v = np.stack([np.ones(n), x[0]], axis=1)
    for i in range(steps):
        if i:
            v = al[i - 1] @ t
            v[:, 1] *= x[i]
        scale[i] = v.sum(axis=1)
        al[i] = v / scale[i][:, None]
    be = np.ones((n, 2))
    p, pair = np.empty((steps, n)), np.zeros((2, 2))
    for i in range(steps - 1, -1, -1):
        g = al[i] * be
        p[i] = g[:, 1] / g.sum(axis=1)
        if i:
            b = be.copy()
            b[:, 1] *= x[i]
            joint = al[i - 1][:, :, None] * t[None] * b[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            be = b @ t.T
            be /= be.sum(axis=1, keepdims=True)
    return p, pair, np.log(scale).sum(axis=0)


YOU = KINDS.index("you")


def distant_labels(docs: list[list[str]], bad: list[bool]) -> list[np.ndarray]:
    """Labels of words from judgements of texts: of an offending text, the words of a kind whose pairs clean texts don't have; where there are none, the words and pairs that clean texts don't have."""
    one, two = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for d, b in zip(docs, bad, strict=True):
        one[b].update(set(d))
        two[b].update(set(zip(d, d[1:], strict=False)))
    only1 = {w for w, n in one[True].items() if n >= 2 and not one[False][w] and w != "#"}
    only2 = {p for p, n in two[True].items() if n >= 2 and not two[False][p]}
    out = []
    for d, b in zip(docs, bad, strict=True):
        y = np.zeros(len(d), np.int8)
        if b:
            own = _kinds(d)[0]
            for i in np.flatnonzero((own != 0) & (own != YOU)):
                y[i] = not any(x in two[False] for x in (tuple(d[max(i - 1, 0) : i + 1]), tuple(d[i : i + 2])))
            if not y.any():
                for i, w in enumerate(d):
                    y[i] = w in only1 or (i > 0 and (d[i - 1], w) in only2) or (i + 1 < len(d) and (w, d[i + 1]) in only2)
        out.append(y)
    return out


def fit(texts: list[str], labels: list[str], rounds: int = 120, l2: float = 0.02) -> Scorer:
    """A scorer from judged texts (labels none, abuse, hate, sexual; others and null are left out), by Adam on the full likelihood."""
    use = [(t, lab != "none") for t, lab in zip(texts, labels, strict=True) if t and lab]
    rough = [Words()(t)[0] for t, _ in use]
    bad = [b for _, b in use]
    clean = Counter(w for d, b in zip(rough, bad, strict=True) if not b for w in set(d))
    lexicon = frozenset(w for d, b in zip(rough, bad, strict=True) if b for w in d if len(w) > 3 and clean[w] <= 3) 
    words = Words(lexicon)
    docs = [words(t)[0] for t, _ in use]
    ys = distant_labels(docs, bad)
    # an offending text in which no word could be labelled says nothing about its words
    told = [i for i, (y, b) in enumerate(zip(ys, bad, strict=True)) if y.any() or not b]
    docs, ys = [docs[i] for i in told], [ys[i] for i in told]
    order = [i for i in np.argsort([len(d) for d in docs]) if docs[i]]
    uni = {i: np.array([_unigrams(w)[0] for w in docs[i]]) for i in order}
    pair = {i: _pairs(np.array([_unigrams(w)[1] for w in docs[i]], np.uint64))[:-1] for i in order}
    kinds = {i: _kinds(docs[i]) for i in order}
    k = len(KINDS)
    params = [np.zeros(FEATURES), np.zeros((FEATURES, 2)), np.zeros(k), np.zeros((k, k)), np.array([[0.0, -2.0], [-2.0, 1.0]])]
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in params]
    rng = np.random.default_rng(3)
    groups = [order[k : k + 128] for k in range(0, len(order), 128)]
    for r in range(1, rounds + 1):
        w, pw, kw, nw, trans = params
        gw, gp, gk, gn, gt = l2 * w, l2 * pw, 0.1 * l2 * kw, 0.1 * l2 * nw, np.zeros((2, 2))
        scorer, blind = Scorer(*params, words), rng.random(len(docs)) < BLIND
        for own in groups:
            n = max(len(docs[i]) for i in own)
            e = np.full((n, len(own)), -50.0)
            for j, i in enumerate(own):
                e[: len(docs[i]), j] = _emit(scorer, uni[i], pair[i], *kinds[i], blind[i])
            p, joint, _ = forward_backward(e, trans)
            gt += joint
            for j, i in enumerate(own):
                m = len(docs[i])
                d = p[:m, j] - ys[i]
                if not blind[i]:
                    for c in range(OWN):
                        np.add.at(gw, uni[i][:, c], d)
                    np.add.at(gw, uni[i][:-1, OWN], d[1:])
                    np.add.at(gw, uni[i][1:, OWN + 1], d[:-1])
                    np.add.at(gp[:, 0], pair[i], d[:-1])
                    np.add.at(gp[:, 1], pair[i], d[1:])
                np.add.at(gk, kinds[i][0], d)
                np.add.at(gn, kinds[i][0], d[:, None] * kinds[i][1])
                y = np.concatenate((ys[i], np.zeros(n - m, np.int8)))
                np.subtract.at(gt, (y[:-1], y[1:]), 1)
        for v, g, (m1, m2) in zip(params, (gw, gp, gk, gn, gt), state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= 0.08 * (1 - r / (rounds + 1)) * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Scorer(*params, words)


def _emit(s: Scorer, uni: np.ndarray, pair: np.ndarray, own: np.ndarray, near: np.ndarray, blind: bool) -> np.ndarray:
    e = s.own[own] + (near * s.near[own]).sum(axis=1)
    if blind:
        return e
    e += s.w[uni[:, :OWN]].sum(axis=1)
    e[1:] += s.w[uni[:-1, OWN]]
    e[:-1] += s.w[uni[1:, OWN + 1]]
    e[:-1] += s.pairs[pair, 0]
    e[1:] += s.pairs[pair, 1]
    return e


def highest(p: np.ndarray) -> float:
    """A document's score: its highest marginal (labels are single words, so a neighbour's marginal says nothing against one)."""
    return float(p.max()) if len(p) else 0.0


#: The last model, by what it was fitted to.
_FITTED: dict[str, Scorer] = {}


def fitted(judged: DataFrame) -> Scorer:
    """The model of a judged table, fitted on at most JUDGED of its rows: those with the smallest hashes of text and label, the same in any order."""
    rows = judged.select("text", "label").filter("text IS NOT NULL AND label IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("text", "label"), "text", "label").limit(JUDGED).collect()  # the judged sample, bounded
    key = hashlib.sha256(repr([tuple(r) for r in rows]).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = fit([r.text for r in rows], [r.label for r in rows])
    return _FITTED[key]


def scores(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, score, words, spans) for each row; ``words`` are the offending words as read, ``spans`` their places in the text (characters).

    Null, empty and blank texts score 0. Whole texts are read, of any length; repeated rows give repeated rows; further columns are left out."""
    model = fitted(judged)
    sent = documents.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.pairs.astype(np.float32), model.own, model.near, model.trans, model.words.lexicon))  # 3 MB, fixed

    def batches(it):
        *weights, lexicon = sent.value
        s = Scorer(*weights, Words(lexicon))
        for b in it:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            split = [s.words(t or "") for t in texts]
            p = s.marginals([s.emissions(d[0]) if d[0] else np.zeros(0) for d in split])
            over = [np.flatnonzero(x > THRESHOLD) for x in p]
            spans = [places(t or "", [d[1][i] for i in o]) for t, d, o in zip(texts, split, over, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([highest(x) for x in p]), pa.array([[d[0][i] for i in o] for d, o in zip(split, over, strict=True)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "words", "spans"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, score double, words array<string>, spans array<struct<start:int,end:int>>")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: the documents whose score is above the threshold."""
    s = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_samples"))
    return s.filter(F.col("score") > THRESHOLD).select("doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_scores: every document's score and offending stretches."""
    s = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_samples"))
    return s.select("doc_id", F.round("score", 4).alias("score"), "words", "spans")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_rates: by source the documents, those above the threshold and their share."""
    docs = table(spark, sf_dir, "documents")
    s = scores(docs, table(spark, sf_dir, "review_samples"))
    flagged = s.groupBy("doc_id").agg(F.max("score").alias("score"))
    j = docs.select("doc_id", "source").join(flagged, "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") > THRESHOLD).cast("long")).alias("flagged"), F.round(F.avg((F.col("score") > THRESHOLD).cast("double")), 6).alias("rate"))


__all__ = ["fit", "scores", "found", "scored", "rates"]
