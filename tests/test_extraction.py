"""Extraction by plug-ins and rules, stacks by mapping, the vector store, identifiers and what surrounds them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobforge.functions import text
from jobforge.operators import combine, extraction, levels, merge, minhash, stacks, vectors
from jobforge.plans import pipelines, reports
from jobforge.sources import files

A = "id string, date date, text string, message_id string, stack_id string, is_unique boolean, location int, work_format int"


def ads(spark, *rows):
    return spark.createDataFrame([(i, dt.date(2024, 1, 1), t, m, s, u, 0, 0) for i, t, m, s, u in rows], A)


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("r")).first().r


def test_answers_are_parsed(spark):
    rows = ['{"p":true,"lb":2000,"ub":3000,"prd":"month","cur":"USD","loc":"middleEast","fmt":2,"pl":"senior"}', '{"p":false,"lb":null,"ub":5,"prd":null,"cur":"GBP"}', "no json", None, '{"loc":99,"pl":"7"}']
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, a string").select("i", extraction.parsed(F.col("a")).alias("p")).orderBy("i").collect()]
    assert tuple(got[0]) == (True, 2000.0, 3000.0, 2, 1, 6, 2, 4)
    assert tuple(got[1]) == (False, None, 5.0, None, None, None, None, None)
    assert all(got[i] is None or set(got[i]) == {None} for i in (2, 3)) and got[4].location is None and got[4].level == 7


@pytest.mark.parametrize(
    "value, want",
    [("Зарплата от 200 000 до 250 000 руб.\nещё 5 USD", (3, 200000.0, 250000.0)), ("Платим 3 800 - 4 300 USD", (1, 3800.0, 4300.0)), ("до 150к ₽", (3, None, 150000.0)), ("€4000", (2, 4000.0, 4000.0)), ("Версия 5, 7 лет", (None, None, None)), ("", None)],
)
def test_rules(spark, value, want):
    got = extraction.by_rules(ads(spark, ("a", value, "m", None, True)), pipelines.by_words).collect()
    assert (got[0].parsed.currency, got[0].parsed.lower, got[0].parsed.upper) == want if want else got == []


def test_extraction_keeps_places_without_pay_and_survives_errors(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def plug_in(t):
        with open(calls, "a") as f:
            f.write(t + "\n")
        if "bad" in t:
            raise ValueError("no")
        return json.dumps({"p": "pay" in t, "lb": 10 if "pay" in t else None, "ub": None, "prd": "day", "cur": "RUB", "loc": "russia", "fmt": "hybrid", "pl": "lead"})

    a = ads(spark, ("a", "pay", "m1", None, True), ("b", "none", "m2", None, True), ("c", "bad", "m1", None, True), ("d", "pay", "m1", None, True), ("e", "  ", "m1", None, True), ("f", None, "m1", None, True))
    m = spark.createDataFrame([("m1", ["#senior"]), ("m1", ["#senior"]), ("m2", [])], "id string, tags array<string>")
    s = spark.createDataFrame([("d",)], "ad_id string")
    got = extraction.extract(a, s, m, pipelines.by_words, plug_in)
    assert [(r.ad_id, r.currency, r.lower_bound, r.upper_bound, r.period, r.level) for r in got["salaries"].collect()] == [("a", 3, 10.0, None, 1, 4)]
    assert sorted((r.id, r.location, r.work_format) for r in got["places"].collect()) == [("a", 1, 2), ("b", 1, 2)]
    assert sorted(open(calls).read().split()) == ["bad", "none", "pay"]


def test_a_spent_quota_ends_the_calls_and_rate_limits_are_tried_again(spark, tmp_path):
    def spent(t):
        raise RuntimeError("insufficient_quota")

    a = ads(spark, *((str(i), f"t{i}", "m", None, True) for i in range(5)))
    assert extraction.answers(a, spent).count() == 0
    seen = f"{tmp_path}/seen"

    def later(t):
        import os

        if not os.path.exists(f"{seen}{t}"):
            open(f"{seen}{t}", "w").close()
            raise RuntimeError("429: try again in 50ms")
        return "{}"

    assert extraction.answers(a.limit(1), later).count() == 1


def test_levels_by_plug_in(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 3, "x"), ("c", None, "boom"), ("d", 0, " "), ("e", 0, "much")], "id string, level int, text string")
    out = levels.with_levels(df, "level", lambda t: {"x": 4, "much": 99}[t])
    assert sorted((r.id, r.level) for r in out.collect()) == [("a", 4), ("b", 3), ("c", 0), ("d", 0), ("e", 0)]


def test_stacks_by_mapping(spark):
    m = spark.createDataFrame([("m1", -1000000000005), ("m2", 6), ("m3", 7)], "id string, telegram_chat_id long")
    chats = spark.createDataFrame([(5,), (7,)], "telegram_id long")
    mapping = spark.createDataFrame([(5, "c", " .net "), (6, "d", "Go"), (7, "e", "none")], "chat_id long, channel string, stack string")
    held = spark.createDataFrame([("s1", ".NET"), ("s2", "go")], "id string, name string")
    a = ads(spark, ("a", "t", "m1", None, True), ("b", "t", "m2", None, True), ("c", "t", "m3", None, True), ("d", "t", "m1", None, False), ("e", "t", "m1", "s9", True), ("f", "t", "zz", None, True))
    assert sorted((r.id, r.stack_id) for r in stacks.resolved(a, m, mapping, held).collect()) == [("a", "s1"), ("b", "s2"), ("d", "s1"), ("e", "s1")]
    assert {r.id: r.stack_id for r in stacks.backfilled(a, m, chats, mapping, held).collect()} == {"a": "s1", "b": None, "c": None, "d": None, "e": "s9", "f": None}
    assert {r.id: r.stack_id for r in stacks.assigned(a, m, chats, held, "GO ").collect()} == {"a": "s2", "b": None, "c": "s2", "d": "s2", "e": "s9", "f": None}
    with pytest.raises(ValueError):
        stacks.assigned(a, m, chats, held, "rust")


def test_ads_vectors_and_buckets_are_one_unit(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/u"
    long = "обычное объявление о работе для разработчика и аналитика "
    first = ads(spark, ("a", long * 3, "m", None, True), ("b", "совсем другой текст о чём-то ином, без повторов", "m", None, False))
    assert vectors.import_ads(spark, at, first) == 1
    with monkeypatch.context() as m:
        m.setattr(merge, "write_text", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            vectors.import_ads(spark, at, ads(spark, ("z", long, "m", None, True)))
    assert {k: df.count() for k, df in merge.published(spark, at).items()} == {"ads": 2, "vectors": 2, "buckets": 40}
    assert vectors.import_ads(spark, at, ads(spark, ("a", "x", "m", None, True), ("c", long * 3, "m", None, True))) == 2
    t = merge.published(spark, at)
    assert {k: df.count() for k, df in t.items()} == {"ads": 3, "vectors": 3, "buckets": 60}
    new = t["ads"].filter("id = 'c'")
    assert vectors.not_duplicates(new, t["vectors"], t["vectors"], t["buckets"], 0.92).count() == 0
    assert vectors.not_duplicates(t["ads"].filter("id = 'b'"), t["vectors"], t["vectors"], t["buckets"], 0.92).count() == 1
    own = vectors.bucket_rows(vectors.get(t["vectors"], new))
    assert [tuple(r) for r in vectors.matches(t["buckets"], own).collect()] == [("c", "a")]
    with pytest.raises(ValueError):
        vectors.add_buckets(t["buckets"], own)
    merge.publish(spark, at, {"vectors": t["vectors"].limit(0), "buckets": t["buckets"].limit(0)})
    assert vectors.backfill(spark, at) == 4
    assert sorted(r.ad_id for r in merge.published(spark, at)["vectors"].collect()) == ["a", "c"]  # b isn't unique


def test_ids_are_migrated_everywhere(spark):
    t = {
        "messages": spark.createDataFrame([("m1", 5, 1), ("m1", 5, 1), ("m2", 5, None)], "id string, telegram_chat_id long, telegram_message_id long"),
        "ads": ads(spark, ("a", "t", "m1", None, True), ("b", "t", "m1", None, True), ("c", "t", "m2", None, True)),
        "salaries": spark.createDataFrame([("s", "a"), ("s2", "b")], "id string, ad_id string"), "vectors": spark.createDataFrame([("a", 1)], "ad_id string, version int"),
    }
    out = merge.migrate_all(t, pipelines.MESSAGES_SPACE, pipelines.ADS_SPACE)
    ids = [r.id for r in out["messages"].collect()]
    assert len(set(ids)) == 2 and "m1" not in ids and "m2" in ids
    moved = {r.id: r.message_id for r in out["ads"].collect()}
    new = (set(moved) - {"b", "c"}).pop()
    assert moved["b"] == moved[new] != "m1" and [r.ad_id for r in out["vectors"].collect()] == [new] and {r.ad_id for r in out["salaries"].collect()} == {new, "b"}
    again = merge.migrate_all(out, pipelines.MESSAGES_SPACE, pipelines.ADS_SPACE)
    assert {r.id for r in again["ads"].collect()} == set(moved)


def test_model_versions(spark):
    held = vectors.model_rows(spark, None, minhash.Model()).withColumn("is_active", F.lit(False))
    got = vectors.model_rows(spark, vectors.model_rows(spark, held, minhash.Model(universe=5000)), minhash.Model(version=2)).collect()
    assert sorted((r.version, r.universe, r.is_active, r.duplicate) for r in got) == [(1, 5000, True, 0.92), (2, 1_000_000, True, 0.92)]


def test_rates_are_brought_up_to_date(spark, tmp_path):
    at, asked = f"file://{tmp_path}/r", []

    def fetch(base, target, since):
        asked.append((target, since))
        return [(base, target, since, 90.0), (base, target, dt.date(2024, 1, 3), 91.0), (base, target, dt.date(2024, 1, 3), 77.0)]

    first = dt.date(2024, 1, 1)
    assert files.refresh_rates(spark, at, fetch, dt.date(2024, 1, 3), first).count() == 4
    assert {(r.target, r.value) for r in files.read_rates_csv(spark, at).filter("date = '2024-01-03'").collect()} == {("USD", 91.0), ("EUR", 91.0)}  # the first counts
    files.refresh_rates(spark, at, fetch, dt.date(2024, 1, 3), first)
    assert asked == [("EUR", first), ("USD", first)]  # nothing to fetch
    assert files.refresh_rates(spark, at, fetch, dt.date(2024, 1, 5), first).count() == 4 and asked[-1][1] == dt.date(2024, 1, 3)
    assert files.currency_code("USD") == "R01235"
    with pytest.raises(ValueError):
        files.currency_code("GBP")


def test_entries_survive_the_round_trip(spark):
    kind = "array<struct<type:string,text:string>>"
    for e in ([("plain", 'a "b"\n'), ("hashtag", "#x")], [], None):
        j = one(spark, files.entries_json, e, kind)
        assert (j == "[]") == (not e)
        assert [tuple(x) for x in one(spark, files.entries_from_json, j)] == (e or [])
    assert one(spark, files.entries_from_json, "") == []


def test_composition(spark):
    assert one(spark, text.compose, "éÅ а") == "éÅ а" and one(spark, text.compose, None) is None
    assert one(spark, text.stack_name, " Café ") == "café"
    got = one(spark, lambda c: text.assemble(c), [("plain", "й 5 000 руб"), ("link", "é"), ("x", None)], "array<struct<type:string,text:string>>")
    assert got == "й 5000₽ é"


def test_short_after_normalising_is_long_enough(spark):
    m = spark.createDataFrame([("a", [("hashtag", "#job"), ("bold", " x" * 200)]), ("b", [("hashtag", "#job"), ("bold", "x" * 200)])], "id string, text_entries array<struct<type:string,text:string>>")
    m = m.union(spark.createDataFrame([("c", [("hashtag", "#job"), ("bold", "x" + " " * 400)])], m.schema))
    assert sorted(r.id for r in levels.job_messages(m).collect()) == ["a", "c"]


def test_localisation_and_pages(spark):
    words = {f"month.{m}": m for m in reports.MONTHS} | {"variant.all": "Все"} | {f"level.{n}": n.upper() for n in ("unknown", "intern", "junior", "middle", "senior", "lead", "architect", "manager")}
    key = lambda v: one(spark, lambda c: reports.month_key(c, words), v)
    assert [key(v) for v in ("2024 03", "12", "2024", "x", None)] == ["2024 march", "december", "2024", "x", None]
    with pytest.raises(Exception, match="no month"):
        key("13")
    assert [one(spark, lambda c: reports.variant_key(c, words), v) for v in ("ALL", "все", "Senior", "other")] == ["Все", "Все", "SENIOR", "other"]
    rows = [{"series": s, "key": "2024 01", "value": 1.0} for s in ("All", "Junior")]
    html = reports.page({"by_month": reports.chart(rows), "x": reports.chart(rows[:1])}, {"by_month": "A<", "x": "B"})
    assert 'class="wide"><h2>A&lt;</h2><select><option>All</option><option>Junior</option></select>' in html and 'class="narrow"><h2>B</h2><canvas>' in html


def test_reader_side_figures(spark):
    nan = float("nan")
    cols = "jobs long, p10 double, p25 double, median double, p75 double, p90 double"
    totals = spark.createDataFrame([("a", 9, *[1.0] * 5), ("b", 5, *[2.0] * 5)], f"stack string, {cols}")
    per = spark.createDataFrame([("a", 3, 4, *[7.0] * 5)], f"stack string, level int, {cols}")
    got = {r.stack: (r.jobs, r.median) for r in combine.at_level(totals, per, 3).collect()}
    assert got["a"] == (4, 7.0) and got["b"][0] == 0 and got["b"][1] != got["b"][1]
    assert combine.at_level(totals, per, None) is totals
    pts = spark.createDataFrame([(2024, 1.0, 1.0, 1), (2024, 3.0, 3.0, 3), (2024, nan, 9.0, 0), (2023, nan, 2.0, 0)], "year int, median double, mean double, n long")
    value = lambda m: {r.year: r.value for r in combine.yearly_metric(pts, m).collect()}
    assert value("max") == {2024: 3.0, 2023: None} and value("min")[2024] == 1.0 and value("avg") == {2024: 2.5, 2023: None} and value("median") == {2024: 3.0}
    sel = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "stack string, n long")
    assert [r.stack for r in combine.selector(sel).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.stack for r in combine.include(sel, ["a"], exclude=True).orderBy("stack").collect()] == ["b", "c"] and combine.include(sel, None) is sel


def test_chunks(spark):
    got = extraction.chunked(spark.range(25).withColumnRenamed("id", "k"), 10, "k").groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 10), (2, 5)]


def test_inserts_take_one_of_equal_keys(spark):
    a, b = spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("1",), ("2",), ("2",)], "id string")
    assert sorted(r.id for r in merge.insert_new(a, b, ["id"]).collect()) == ["1", "2"] and merge.cleared(a).count() == 0


def test_places_of_several_rows_and_unknown_ones(spark):
    a = ads(spark, ("a", "t", "m", None, True), ("b", "t", "m", None, True))
    found = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("b", 0, 0)], "id string, location int, work_format int")
    assert sorted((r.id, r.location, r.work_format) for r in merge.update_places(a, found).collect()) == [("a", 2, 0), ("b", 0, 0)]
