"""Labelled spans and training of the model in ``pii_model.npz``.

``python -m jobforge.llm.pii_train ADS.parquet`` labels a bounded sample of ads (SAMPLE rows) by context rules, replaces half of the labelled names by
made-up ones, cuts windows and trains. The rules only see what stands in a known context; the model has to find the rest. With ``--widen`` it goes on
from the model that is there: half of the windows are then sentences of ``pii_data``, put between lines of ads in which no rule finds anything.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np

from jobforge.llm import charlstm as net
from jobforge.llm.pii_data import made
from jobforge.llm.pii import KINDS, MODEL, TAGS

SAMPLE, STEPS, BATCH, HIDDEN = 9000, 3000, 128, 20
#: Windows that are trained on: their size, their distance and what they must hold; in use, longer windows are scored, whatever they hold.
WINDOW, STRIDE = 160, 128
NEEDED = re.compile(
    r"@|[(\[]\s?at\s?[)\]]|\sat\s|собака|\d(?:[\s().\-–/]*\d){5}|[A-ZА-ЯЁ][\w\-]*,?\s[^\n\d]{0,12}\d|\b[A-ZА-ЯЁ][\w\-]*\.?\s+[A-ZА-ЯЁ]"
    r"|\b(?:ул|улица|просп|проспект|пер|переулок|д|дом)[. ]|\b(?:писать|пишите|звон|позвон|контакт|обращ|спрос|вопросы|зовут|менеджер|contact|call|ask|regards|recruiter|manager)|[\u4e00-\u9fff]"
)


def suspicious(text: str) -> bool:
    """Whether a stretch is worth training on."""
    return NEEDED.search(text) is not None
W = r"[А-ЯЁA-Z][а-яёa-z]{2,}"
EMAIL = re.compile(r"[\w.+\-]+ ?@ ?[\w\-]+(?:\.[\w\-]+)*\.[a-zA-Z]{2,}\b|[\w.+\-]+ ?(?:[(\[]at[)\]]|собака) ?[\w\-]+(?: ?(?:[(\[]dot[)\]]|точка|\.) ?[\w\-]+)+", re.I)
IDENTITY = re.compile(r"(?:ИНН(?: физлица)?(?: №)?|СНИЛС:?|снилс:?|паспорт|passport no\.|SSN|national ID|ID card) ?((?:[A-ZА-Я]{2}[ \-]?)?\d[\d \-]{5,}\d)", re.I)
PHONE = re.compile(r"(?<![\w№@.\-])(?:\+?\d[\d \xa0.\-–()]{6,}\d|\(\d{3}\)[\d \-]{6,}\d)(?: доб\. ?\d+| ext\.? ?\d+)?")
NOT_PHONE = re.compile(r"(?:№|requisition|заявки|заявка|протокол|версии|ports|порт|build|ИНН|снилс|паспорт|passport no\.|SSN|national ID|системе|[$€₽]) ?$|(?:зарплата|зп:?|оплата:?|доход|вилка|платим|бюджет —|💰|salary:?|budget|compensation:?|pay|от|до|from|to|up to|-|–|—) ?[$€₽]?$", re.I)
PAY_AFTER = re.compile(r"^\s*(?:[$€₽]|руб|р\.|rub|usd|eur|долл|бакс|dollars|euros|roubles|тыс|[kк]\b|в месяц|мес|/)", re.I)
STREET_RU = r"(?:(?:г\. )?[А-ЯЁ][а-яё\-]+(?:-[А-ЯЁ][а-яё]+)?, )?(?:ул\.?|улица|пер\.|переулок|пр-т|проспект|шоссе|наб\.|бульвар|б-р) [А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)?,? (?:(?:д\.|дом) ?)?\d+(?:[/к]\d+)?(?:,? ?(?:стр|оф|кв|подъезд|корп)\.? ?\d+)*"
STREET_EN = r"\d+ (?:[A-Z][a-z]+ ){1,3}(?:Street|St\.?|Road|Rd\.?|Lane|Ave\.?|Avenue)(?:, (?:floor|apt) \d+)?|(?:[A-Z][a-z]+ ){1,3}(?:Street|St\.?|Road|Rd\.?|Lane|Ave\.?|Avenue) \d+(?:, (?:floor|apt) \d+)?"
ADDRESS = re.compile(STREET_RU + "|" + STREET_EN)
NAME_CONTEXT = [
    re.compile(r"(?:на ресепшене|[Рр]екрутер|[Оо]ткликаться|[Пп]ортфолио присылать|[Вв]опросы задавайте|[Кк]онтактное лицо:|[Кк]оманду собирает|тимлид —|[Aa]sk for|report to|recruiter is|[Cc]ontact person:|[Hh]iring manager:) (" + W + ") (" + W + ")"),
    re.compile(r"(" + W + ") (" + W + r"), (?=[+(\d][\d ()\-.+]{9})"),
]


def name_words(texts: list[str]) -> set[str]:
    """Stems (five letters) of words that stand for a name in a known context at least twice, so that other cases and genders count too."""
    n: dict[str, int] = {}
    for t in texts:
        for rx in NAME_CONTEXT:
            for m in rx.finditer(t):
                for g in m.groups():
                    n[g[:5]] = n.get(g[:5], 0) + 1
    return {w for w, k in n.items() if k >= 2}


def spans(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """Labelled spans (start, end, kind) by rules, not overlapping."""
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(1), m.end(1), "identity") for m in IDENTITY.finditer(text)]
    found += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 18 and not NOT_PHONE.search(text[: m.start()]) and not PAY_AFTER.search(text[m.end() :]) and not re.match(r"\d{1,3}([ \xa0.]\d{3})*\s?[-–]\s?\d", m.group()):
            found.append((m.start(), m.end(), "phone"))
    for m in re.finditer(r"(?=\b(" + W + ") +(" + W + r")\b)", text):
        if m.group(1)[:5] in names and m.group(2)[:5] in names:
            found.append((m.start(1), m.end(2), "name"))
    for m in re.finditer(r"\b(" + W + r") [А-ЯЁA-Z]\. ?[А-ЯЁA-Z]\.|[А-ЯЁA-Z]\. ?[А-ЯЁA-Z]\. ?(" + W + r")\b", text):
        if (m.group(1) or m.group(2))[:5] in names:
            found.append((m.start(), m.end(), "name"))
    out, end = [], 0
    for a, b, k in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b, k))
            end = b
    return out


RU1, RU2 = ["ма", "ри", "ле", "ка", "то", "ве", "да", "ни", "со", "лю", "ар", "гри", "фё", "ю"], ["ша", "на", "мир", "гей", "лия", "тон", "слав", "ня", "рис", "фья"]
RUS = ["ов", "ова", "ин", "ина", "ский", "ская", "енко", "ук", "ев", "ева"]
EN1, EN2 = ["ma", "jo", "e", "ro", "li", "a", "to", "cla", "ne", "vi"], ["ra", "nas", "bert", "lly", "son", "mie", "nnor", "ric", "sa"]
ENS = ["wood", "ley", "ham", "ford", "mark", "worth", "by", "croft", "dale", "rath"]


def invented(word: str, last: bool, rng: np.random.Generator) -> str:
    ru = bool(re.search("[а-яё]", word))
    a, b, c = (RU1, RU2, RUS) if ru else (EN1, EN2, ENS)
    w = "".join(rng.choice(a) for _ in range(rng.integers(1, 3))) + (rng.choice(["р", "л", "н", "м"] if ru else ["r", "l", "n", "m"]) + rng.choice(c) if last else rng.choice(b))
    return w[0].upper() + w[1:]


def varied(text: str, marked: list, rng: np.random.Generator) -> tuple[str, list]:
    """The text with some of its names replaced by made-up ones, and its spans."""
    out, new, at = [], [], 0
    for a, b, k in marked:
        out.append(text[at:a])
        piece = text[a:b]
        if k == "name" and rng.random() < 0.5:
            words = list(re.finditer(W, piece))
            for i, m in reversed(list(enumerate(words))):
                piece = piece[: m.start()] + invented(m.group(), i == len(words) - 1, rng) + piece[m.end() :]
        start = sum(map(len, out))
        out.append(piece)
        new.append((start, start + len(piece), k))
        at = b
    out.append(text[at:])
    return "".join(out), new


def windows(texts: list[str], names: set[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for t in texts:
        t, marked = varied(t, spans(t, names), rng)
        y = np.zeros(len(t), np.int8)
        for a, b, k in marked:
            y[a:b] = TAGS.index(k)
        x = net.classes(t)
        for s in range(int(rng.integers(0, STRIDE)) - STRIDE, len(t), STRIDE):
            a, b = max(s, 0), min(s + WINDOW, len(t))
            if b - a < 8 or not suspicious(t[a:b]):
                continue
            px, py = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int8)
            px[: b - a], py[: b - a] = x[a:b], y[a:b]
            xs.append(px)
            ys.append(py)
    return np.array(xs), np.array(ys)


def inserted(texts: list[str], names: set[str], rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made sentences between plain lines."""
    lines = [x for t in texts[:2000] for x in t.split("\n") if x and not spans(x, names)]
    xs, ys = np.zeros((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int8)
    for i in range(n):
        said, marked = made(rng, "train")
        before = lines[rng.integers(len(lines))][-int(rng.integers(1, 90)) :] + str(rng.choice(["\n", ". ", "\n- ", " "]))
        t = before + said + str(rng.choice(["\n", ". ", " "])) + lines[rng.integers(len(lines))]
        y = np.zeros(len(t), np.int8)
        for a, b, k in marked:
            y[len(before) + a : len(before) + b] = TAGS.index(k)
        a = int(rng.integers(0, max(1, min(40, len(t) - WINDOW))))
        x = net.classes(t)[a : a + WINDOW]
        xs[i, : len(x)], ys[i, : len(x)] = x, y[a : a + WINDOW]
    return xs, ys


def widen(path: str, steps: int = 1100, rate: float = 0.006, seed: int = 11) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    names, rng = name_words(texts), np.random.default_rng(seed)
    sample = [texts[i] for i in rng.permutation(len(texts))[: SAMPLE // 3]]
    x, y = windows(sample, names, rng)
    keep = np.flatnonzero((y > 0).any(axis=1) | (rng.random(len(y)) < 0.5))
    p, q = inserted(texts, names, rng, 40_000)
    batches = []
    for _ in range(steps):
        i, j = rng.choice(keep, BATCH // 2, replace=False), rng.choice(len(p), BATCH // 2, replace=False)
        batches.append((np.concatenate((x[i], p[j])).T.copy(), np.concatenate((y[i], q[j])).T.copy()))
    with np.load(MODEL) as f:
        m = {k: f[k] for k in f.files}
    m = net.train(m, batches, rate=rate, report=lambda i, loss: print(i, round(loss, 3), flush=True) if i % 50 == 0 else None)
    np.savez_compressed(Path(MODEL), **{k: v.astype(np.float32) for k, v in m.items()})


def main(path: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    names = name_words(texts)
    rng = np.random.default_rng(5)
    sample = [texts[i] for i in rng.permutation(len(texts))[:SAMPLE]]
    x, y = windows(sample, names, rng)
    held = len(x) // 10
    keep = np.flatnonzero((y[held:] > 0).any(axis=1) | (rng.random(len(y) - held) < 0.5)) + held
    print(len(names), "name words;", len(x), "windows", flush=True)
    batches = [(x[i].T.copy(), y[i].T.copy()) for i in (rng.choice(keep, BATCH, replace=False) for _ in range(STEPS))]
    m = net.train(net.new_model(HIDDEN, len(TAGS)), batches, report=lambda i, loss: print(i, round(loss, 3), flush=True) if i % 50 == 0 else None)
    p = net.viterbi(net.emissions(net.folded(m), x[:held].T), m["trans"]).T
    for k in KINDS:
        t = TAGS.index(k)
        hit, said, there = ((p == t) & (y[:held] == t)).sum(), (p == t).sum(), (y[:held] == t).sum()
        print(k, "held-out characters: precision", round(hit / max(said, 1), 4), "recall", round(hit / max(there, 1), 4), flush=True)
    np.savez_compressed(Path(MODEL), **{k: v.astype(np.float32) for k, v in m.items()})


if __name__ == "__main__":
    (widen if "--widen" in sys.argv else main)(sys.argv[1])
