"""Byte-pair encoding against a public library, packing against brute force, sketches against sorted values."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from jobforge.llm import bpe, packing, quantile_sketch

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no public vocabularies")
D = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def test_same_ids_as_the_library(public):
    rnd = random.Random(2)
    enc = bpe.Encoder(bpe.load_ranks())
    pieces = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "'s", "Я", "ж", "1", "23", ".", "!!", "👉", "　", "​", "слово", " word", "<|endoftext|>", "é", "中"]
    for _ in range(3000):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 16)))
        assert np.frombuffer(enc.packed(s), "<i4").tolist() == public.encode_ordinary(s), repr(s)


def test_whole_column(spark, public):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " ", "", ""), (4, "<|endoftext|> Привет", "", ""), (5, "ab" * 30_000, "", ""), (4, "<|endoftext|> Привет", "", "")]
    got = [(r.doc_id, r.ids) for r in bpe.encode_column(spark.createDataFrame(rows, D)).orderBy("doc_id").collect()]
    assert got == sorted((i, public.encode_ordinary(t) if t else []) for i, t, *_ in rows)
    assert bpe.encode_column(spark.createDataFrame([], D)).count() == 0
    n = {r.doc_id: r.n_tokens for r in bpe.encode_column(spark.createDataFrame(rows, D), counts_only=True).collect()}
    assert n == {i: len(x) for i, x in got}


def test_fullest_is_the_best_sum():
    rnd = random.Random(3)
    for _ in range(300):
        items = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))]
        room = rnd.randint(0, 60)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        many = sorted(((n, items.count(n)) for n in set(items)), reverse=True)
        got = packing.fullest(many, room)
        assert sum(got) == best and all(got.count(n) <= items.count(n) for n in set(got))


def test_containers(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["word"] * rnd.choice([1, 5, 30, 64, 65, 200])), "", "") for i in range(200)] + [(900, None, "", ""), (901, "", "", "")]
    got = packing.containers(spark.createDataFrame(rows, D), capacity=64, group=60).collect()
    by = {}
    for r in got:
        if r.container:
            by.setdefault(r.container, []).append(r)
    assert all(sum(r.n_tokens for r in x) == x[0].fill <= 64 for x in by.values())
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.part, r.start, r.n_tokens))
    assert set(whole) == {r[0] for r in rows}
    for i, t, *_ in rows:
        parts = sorted(whole[i])
        n = len(t.split()) if t else 0
        assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(max(1, math.ceil(n / 64)))) and all(p[1] == 64 * p[0] for p in parts)
    assert {r.doc_id for r in got if r.container is None} == {900, 901}
    assert packing.containers(spark.createDataFrame([], D)).count() == 0


S = "id int, g string, v double, value string"


def test_quantiles_within_the_stated_bound(spark):
    rng = np.random.default_rng(1)
    v = np.exp(rng.normal(11, 1, 6000)).round(2)
    rows = [(i, "a" if i % 3 else "b", float(x), "") for i, x in enumerate(v)] + [(-1, "a", None, ""), (-2, "a", math.nan, ""), (-3, "a", -5.0, ""), (-4, "c", 0.0, ""), (-5, "a", math.inf, "")]
    df = spark.createDataFrame(rows, S)
    got = quantile_sketch.quantiles(quantile_sketch.sketch(df, ["g"], "v"), ["g"]).collect()
    assert {r.g for r in got} == {"a", "b"}
    for r in got:
        x = np.sort(v[[i % 3 > 0 if r.g == "a" else i % 3 == 0 for i in range(len(v))]])
        lo, hi = np.searchsorted(x, r.value * (1 - quantile_sketch.VALUE_ERROR * 1.01)), np.searchsorted(x, r.value * (1 + quantile_sketch.VALUE_ERROR * 1.01), "right")
        k = math.ceil(r.q * len(x))
        assert r.n == len(x) and max(0, lo + 1 - k, k - hi) <= r.rank_error


def test_merge_and_deletion_are_exact(spark):
    df = spark.createDataFrame([(i, "x", float(i % 97 + 1), "") for i in range(500)], S)
    whole = quantile_sketch.sketch(df, ["g"], "v")
    parts = quantile_sketch.sketch(df.filter("id < 200"), ["g"], "v").unionByName(quantile_sketch.sketch(df.filter("id >= 200"), ["g"], "v"))
    key = ["g", *quantile_sketch.COUNTERS]
    same = lambda a, b: sorted(map(tuple, a.filter("count <> 0").collect())) == sorted(map(tuple, b.filter("count <> 0").collect()))
    assert same(quantile_sketch.merge(parts, ["g"]), whole)
    rest = quantile_sketch.minus(whole, quantile_sketch.sketch(df.filter("id < 200"), ["g"], "v"), ["g"])
    assert same(rest, quantile_sketch.sketch(df.filter("id >= 200"), ["g"], "v")) and key
    assert quantile_sketch.sketch(df.limit(0), ["g"], "v").count() == 0


def test_the_bound_holds_over_many_groups(spark):
    q = quantile_sketch
    rows, held = [], {}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        v = np.exp(rng.normal(11, 0.2 + seed / 20, 3000))
        held[f"s{seed}"] = np.sort(v)
        rows += [(0, f"s{seed}", float(x), "") for x in v]
    got = q.quantiles(q.sketch(spark.createDataFrame(rows, S), ["g"], "v"), ["g"]).collect()
    assert len(got) == 20 * len(q.QUANTILES) and q.K > 3
    off = []
    for r in got:
        x = held[r.g]
        lo, hi = np.searchsorted(x, r.value * (1 - q.VALUE_ERROR * 1.01)), np.searchsorted(x, r.value * (1 + q.VALUE_ERROR * 1.01), "right")
        k = math.ceil(r.q * len(x))
        off.append(max(0, lo + 1 - k, k - hi))
        assert 0 < r.rank_error < 0.05 * len(x) and off[-1] <= r.rank_error
    assert np.mean(off) < 0.002 * 3000


def test_small_groups_stay_codes_and_grow_into_the_same_sketch(spark):
    q = quantile_sketch
    df = spark.createDataFrame([(i, "x", 1.01 ** (i % 400), "") for i in range(2000)], S)
    small, whole = q.sketch(df.filter("id < 200"), ["g"], "v"), q.sketch(df, ["g"], "v")
    assert {r.shift for r in small.select("shift").distinct().collect()} == {q.RAW} and whole.filter(f"shift = {q.RAW}").count() == 0
    exact = q.quantiles(small, ["g"], (0.5,)).first()
    assert exact.rank_error == 0 and exact.n == 200 and abs(exact.value / 1.01**99 - 1) <= q.VALUE_ERROR * 1.01
    grown = q.merge(small.unionByName(q.sketch(df.filter("id BETWEEN 200 AND 399"), ["g"], "v")).unionByName(q.sketch(df.filter("id >= 400"), ["g"], "v")), ["g"])
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))
