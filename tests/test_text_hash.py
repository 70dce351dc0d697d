import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobforge.functions import hashing, text
from jobforge.operators import levels, minhash


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr(F.col("v"))).collect()]


def test_separators_and_first_only(spark):
    assert one(spark, text.drop_loose_separators, "a .. b , c") == ["a . b  c"]
    assert one(spark, text.normalize_ad, "a .. b , c", None, "") == ["a . b c", None, ""]
    assert one(spark, text.first_amount_sign, "100 $ и 200 $") == ["100$ и 200 $"]


def test_entries(spark):
    got = one(spark, text.normalize_entry, "от 100 000 – 120 000 рублей!", "3 000 USD", "europe")
    assert got == ["от 100000-120000₽", "3000$", "€ pe"]
    assert one(spark, text.normalize_tag, " ##Team__Lead ", "#a___b") == ["#team_lead", "a_b"]


def test_shingles(spark):
    assert one(spark, lambda c: F.size(text.shingle_set(c)), "abcd", "abcde", "aaaaaaa") == [0, 1, 1]


def fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_fnv(spark):
    words = ["", "a", "foobar", "Привет", "🙂"]
    assert one(spark, hashing.fnv1a, *words, None) == [fnv(w.encode()) for w in words] + [None]
    assert fnv(b"foobar") == 0xBF9CF968
    t = "abПривет🙂xyz"
    assert hashing.shingle_hashes(t).tolist() == [fnv(t[i : i + 5].encode()) for i in range(len(t) - 4)]


def test_fnv_of_long_texts_takes_time_in_proportion(spark):
    """Thousands of letters took minutes when each byte was looked up from the text's beginning."""
    import time

    rng = np.random.default_rng(5)
    texts = ["я" * 20_000, None, ""] + ["".join(rng.choice(list("abя🙂 "), n)) for n in rng.integers(0, 300, 200)] + ["x" * 5000]
    began = time.time()
    assert one(spark, hashing.fnv1a, *texts) == [None if t is None else fnv(t.encode()) for t in texts]
    assert time.time() - began < 20


def test_fnv_of_slices():
    import pyarrow as pa

    words = [f"слово{i}" * (i % 7) for i in range(100)]
    got = hashing.fnv_batch(pa.array([w.encode() for w in words]).slice(13, 70))
    assert got.tolist() == [fnv(w.encode()) for w in words[13:83]] and len(hashing.fnv_batch(pa.array([], pa.binary()))) == 0


def test_seeded_draws():
    assert [next(hashing.seeded_draws(s)) for s in (0, 42, 1)] == [1559595546, 1434747710, 534011718]
    masks, bits = hashing.family()
    assert bits == 20 and len(masks) == 100 and masks[:4].tolist() == [325467165, 1623525913, 980737479, 1490890881]


def test_signatures_and_bands():
    masks, bits = hashing.family(50, 10000, 999)
    a = hashing.signature(hashing.shingle_hashes("Senior Backend Engineer in Berlin", 3), masks, bits)
    assert len(a) == 50 and (a == hashing.signature(hashing.shingle_hashes("Senior Backend Engineer in Berlin", 3), masks, bits)).all()
    assert (hashing.signature(hashing.shingle_hashes("ab", 3), masks, bits) == 0xFFFFFFFF).all()
    assert hashing.unpack_signature(hashing.pack_signature([0, 1, 123456789, 4294967285])) == [0, 1, 123456789, 4294967285]
    k = hashing.band_keys(np.arange(100, dtype=np.uint32), 20)
    assert len(k) == 20 and all(len(x) == 8 for x in k)
    with pytest.raises(ValueError):
        minhash.Model(hashes=10, bands=3)
    assert minhash.Model(hashes=120, bands=24, version=0).version == 1 and minhash.Model(hashes=120, bands=24).rows == 5


def test_agreement(spark):
    rows = [([1, 2, 3, 4], [1, 2, 3, 4]), ([1, 2, 3, 4], [5, 6, 7, 8]), ([1, 2, 3, 4], [1, 9, 3, 8]), ([1, 2, 3], [1, 2, 3, 4]), ([], [])]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(hashing.agreement(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.5, 0.0, 0.0]


def test_name_guid(spark):
    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    import hashlib

    got = one(spark, lambda c: hashing.name_guid(ns.bytes_le.hex(), c), "abc")[0]
    d = bytearray(hashlib.sha1(ns.bytes_le + b"abc").digest()[:16])
    d[7], d[8] = d[7] & 0x0F | 0x50, d[8] & 0x3F | 0x80
    # the version nibble is set in the mixed-endian layout, at byte 7
    assert got == str(uuid.UUID(bytes_le=bytes(d)))


def test_greedy_keeps_the_end_of_a_chain(spark):
    # A ~ B and B ~ C in that order: A is kept, B dropped, and C, whose only neighbour is gone, is kept
    b = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("b", 1, "y"), ("c", 1, "y"), ("e", 2, "z"), ("e", 2, "z")], "id string, band int, key string")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "id string, r int").select("id", F.struct("r").alias("rank"))
    assert sorted(r.id for r in minhash.greedy_distinct(order, b).collect()) == ["a", "c", "d", "e"]


def test_greedy_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{i:03}", int(b), str(rng.integers(0, 25))) for i in range(120) for b in range(3)]
    kept, used = [], set()
    for i in range(120):
        own = {(b, k) for n, b, k in rows if n == f"i{i:03}"}
        if not own & used:
            kept.append(f"i{i:03}")
            used |= own
    order = spark.createDataFrame([(f"i{i:03}", i) for i in range(120)], "id string, r int").select("id", F.struct("r").alias("rank"))
    assert sorted(r.id for r in minhash.greedy_distinct(order, spark.createDataFrame(rows, "id string, band int, key string")).collect()) == kept


def test_levels(spark):
    rows = [(["#senior"],), (["#Team__Lead", "#junior"],), (["#вакансия"],), ([],), (None,), (["#seniorqa", "#pm"],)]
    assert [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(levels.resolve_level(F.col("t"))).collect()] == [4, 5, 0, 0, 0, 7]


def test_job_messages(spark):
    long = "слово " * 80
    e = lambda *tags: [{"type": "hashtag", "text": t} for t in tags] + [{"type": "plain", "text": long}, {"type": "plain", "text": ""}]
    rows = [(1, e("#вакансия")), (2, e("#вакансия", "#резюме")), (3, e("#Вакансия")), (4, e()), (5, None), (6, [{"type": "hashtag", "text": "#job"}])]
    df = spark.createDataFrame(rows, "id int, text_entries array<struct<type:string,text:string>>")
    assert [r.id for r in levels.job_messages(df).collect()] == [1]
