"""Near-duplicates and repeats in batches, against brute force."""

import datetime as dt
import itertools
import random

import pytest
import regex

from jobforge.llm import fingerprint as fp
from jobforge.llm import history, near_dup

A = "id string, created_at timestamp, date date, text string, tid string, s0 string"


def norm(t):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).strip()


def sets(t):
    n = norm(t)
    return {n[i : i + 5] for i in range(len(n) - 4)}


def corpus(n=90, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(rnd.randint(3, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(45, 90)))
        rows.append(t)
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w = t.split()
            for _ in range(rnd.randint(0, 4)):
                j = rnd.randrange(len(w))
                kind = rnd.randrange(4)
                w[j] = w[j].upper() if kind == 0 else w[j] + "!" if kind == 1 else w[j][1:] if kind == 2 else rnd.choice(words)
            cut = rnd.randrange(len(w))
            rows.append(" ".join(w[cut:] + w[:cut]))
    extra = [None, "", "   ", "абв", "абв", "абвгд", "абвгд!", "x" * 40, "x" * 90, "я" * 300_000]
    out = []
    for i, t in enumerate(rows + extra):
        run = rnd.choice([1, 1, 2, 3])
        out.append((f"id{i:04}", dt.datetime(2024, run, 1), dt.date(2023, rnd.randint(1, 12), 1), t, "clash", "clash"))
    return [*out, out[0], out[5]]


def truth(rows):
    own = {r[0]: sets(r[3]) for r in rows}
    out = set()
    for a, b in itertools.combinations(own, 2):
        x, y = own[a], own[b]
        if min(len(x), len(y)) >= 0.7 * max(len(x), len(y), 1) and x and len(x & y) >= 0.7 * len(x | y):
            out.add(tuple(sorted((a, b))))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def pairs(rows):
    return truth(rows)


def test_all_pairs(spark, rows, pairs):
    got = near_dup.similar_pairs(spark.createDataFrame(rows, A).repartition(6)).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs and len(pairs) > 40


def test_no_rows(spark):
    assert near_dup.similar_pairs(spark.createDataFrame([], A)).count() == 0
    assert near_dup.similar_pairs(spark.createDataFrame([("a", None, None, None, "", "")], A)).count() == 0


def test_batches_equal_one_pass(spark, rows, pairs, tmp_path):
    key = {r[0]: (r[1], r[2], r[0]) for r in rows}
    want = {max(p, key=lambda i: key[i]) for p in pairs}
    df = spark.createDataFrame(rows, A)
    by_run = [df.filter(f"month(created_at) = {m}") for m in (1, 2, 3)]
    got = [r.id for r in history.repeats(spark, by_run, path=f"file://{tmp_path}/h").collect()]
    assert sorted(got) == sorted(want)
    assert sorted(r.id for r in history.repeats(spark, history.by_run(df)).collect()) == sorted(want)
    later = spark.createDataFrame([("zz", dt.datetime(2025, 1, 1), None, rows[3][3], "", ""), ("zy", dt.datetime(2025, 1, 1), None, "совсем другой текст, которого не было", "", "")], A)
    again = history.HistoryIndex(spark, f"file://{tmp_path}/h")
    assert [r.id for r in again.ingest(later).collect()] == ["zz"]
    assert again.ingest(later.limit(0)).count() == 0


def test_hot_group_of_copies(spark):
    same = [(f"c{i:03}", dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), "одно и то же объявление о работе", "", "") for i in range(60)]
    df = spark.createDataFrame(same, A)
    assert near_dup.similar_pairs(df).count() == 60 * 59 // 2
    assert sorted(r.id for r in history.repeats(spark, [df]).collect()) == [f"c{i:03}" for i in range(1, 60)]


def test_normalising_is_the_stated_rule(rows):
    texts = [r[3] for r in rows] + ["İx", "a\0b", "٣٤ x", "é́ x"]
    assert fp.normalised(texts) == [norm(t) for t in texts]


def test_packing_round_trip(rows):
    for t in fp.normalised([r[3] for r in rows]):
        assert fp.unpack(fp.pack(t)) == t


def test_classes(spark):
    both = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x")], "id_1 string, id_2 string")
    assert {r.id: r.label for r in near_dup.connected(both).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_a_long_chain_is_one_class(spark):
    n = [f"n{i:03}" for i in range(40)]
    e = [(a, b) for a, b in zip(n, n[1:], strict=False)]
    both = spark.createDataFrame(e + [(b, a) for a, b in e], "id_1 string, id_2 string")
    assert {r.label for r in near_dup.connected(both).collect()} == {"n000"}


def spread_edits(every, n=40):
    """Texts and copies of them with a letter changed in every so many words."""
    rnd = random.Random(7)
    letters = "абвгдежзиклмнопрст"
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 10))) for _ in range(2000 if i == 0 else 80)]
        edited = [w[:-1] + "ю" if k % every == 0 else w for k, w in enumerate(words)]
        for run, w in ((1, words), (1 + i % 2, edited)):
            rows.append((f"{i:02}{'ab'[w is edited]}", dt.datetime(2024, run, 1), dt.date(2024, 1, 1), " ".join(w), "", ""))
    return rows


@pytest.mark.parametrize("small", [20_000, 0])
def test_scattered_edits_are_found(spark, small):
    rows = [(f"{k}-{r[0]}", *r[1:3], f"{k} " + r[3].replace("а", "абвгд"[k % 5]), *r[4:]) for k in (4, 5, 6, 8) for r in spread_edits(k, 24)]
    want = sorted({max(p) for p in truth(rows)})
    got = sorted(r.id for r in history.repeats(spark, history.by_run(spark.createDataFrame(rows, A)), small=small).collect())
    assert len(want) > 60 and got == want


def test_tokens_are_shared_as_often_as_stated():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("абвгдежзиклмн") for _ in range(rnd.randint(5, 9))) for _ in range(4000)]
    texts, near = [], []
    while len(texts) < 400:
        w = [rnd.choice(words) for _ in range(90)]
        v = [x[:-1] + "ю" if k % 4 == 0 else x for k, x in enumerate(w)]
        if 0.69 <= fp.jaccard(" ".join(w), " ".join(v)) <= 0.76:
            texts.append(" ".join(w))
            near.append(" ".join(v))
    x, y = fp.tokens(texts)[0], fp.tokens(near)[0]
    shared = (x == y).sum(axis=1)
    assert (shared < fp.SHARED).sum() <= 1 and 6 < shared.mean() < 14
    df = fp.np.zeros(fp.COUNTERS, fp.np.int32)
    fp.np.add.at(df, (x & fp.np.uint32(fp.COUNTERS - 1)).astype(int), 1)
    for a, b, n in zip(fp.prefixes(x, df), fp.prefixes(y, df), shared, strict=True):
        assert n < fp.SHARED or set(a) & set(b)


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    rows = spread_edits(8, 8)
    runs = history.by_run(spark.createDataFrame(rows, A))
    index = history.HistoryIndex(spark, f"file://{tmp_path}/h")
    got = [r.id for r in index.ingest(runs[0]).collect()]
    with monkeypatch.context() as m:
        m.setattr(history, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.ingest(runs[1])
    again = history.HistoryIndex(spark, f"file://{tmp_path}/h")
    assert again.manifest()["version"] == 1
    got += [r.id for r in again.ingest(runs[1]).collect()]
    assert sorted(got) == sorted({max(p) for p in truth(rows)})


def test_hot_tokens_and_merged_segments(spark, rows, pairs, tmp_path):
    key = {r[0]: (r[1], r[2], r[0]) for r in rows}
    want = {max(p, key=lambda i: key[i]) for p in pairs}
    runs = history.by_run(spark.createDataFrame(rows, A))
    for small, hot in ((0, 1), (20_000, 1)):
        at = f"file://{tmp_path}/h{small}"
        assert sorted(r.id for r in history.repeats(spark, runs, path=at, small=small, hot=hot, fan=2).collect()) == sorted(want)
        left = history.HistoryIndex(spark, at).manifest()
        assert [s[3] for s in left["postings"]] == [1, 0] and len(left["texts"]) == 3
