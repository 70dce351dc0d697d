import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobforge.operators import merge, minhash, rates
from jobforge.operators.delivery import PostStore
from jobforge.sources import files
from jobforge.streaming.append import counts_stream, import_stream


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merges(spark):
    held = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "k int, v string, made string")
    assert rows(merge.insert_new(held, new, ["k"]), "k") == [(1, "a", "old"), (2, "b", "old"), (3, "C", "new")]
    assert rows(merge.upsert(held, new, ["k"], ["v"]), "k") == [(1, "a", "old"), (2, "B", "old"), (3, "C", "new")]
    changed = merge.update_where(held, spark.createDataFrame([(1, "z"), (2, None)], "k int, v string"), "k", ["v"])
    assert rows(changed, "k") == [(1, "z", "old"), (2, "b", "old")]
    assert rows(merge.upsert(held.limit(0), new, ["k"], ["v"]), "k") == [(2, "B", "new"), (3, "C", "new")]


def test_migration_keeps_ids_in_use(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    m = spark.createDataFrame([("a", "x"), ("b", "c")], "old string, new string")
    assert rows(merge.migrate_ids(t, m, "id"), "id") == [("b",), ("c",), ("x",)]


def test_vectors_keep_their_creation(spark):
    held = spark.createDataFrame([("a", 1, "p", 10)], "id string, version int, payload string, created_at int")
    new = spark.createDataFrame([("a", 1, "q", 20), ("b", 1, "r", 20)], "id string, version int, payload string, created_at int")
    assert rows(minhash.upsert_vectors(held, new), "id") == [("a", 1, "q", 10), ("b", 1, "r", 20)]


def test_unique_mark_never_falls(spark):
    ads = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, is_unique boolean")
    assert rows(minhash.mark_unique(ads, spark.createDataFrame([("b",)], "id string")), "id") == [("a", True), ("b", True), ("c", False)]


def test_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("RUB,USD,2024-01-01,90\nbad line\nRUB,USD,2024-01-01,91.5\nRUB,EUR,2024-01-03,99\na,b,c,d\n")
    r = files.read_rates_csv(spark, f"file://{tmp_path}/r.csv")
    assert rows(r, "target") == [("RUB", "EUR", dt.date(2024, 1, 3), 99.0), ("RUB", "USD", dt.date(2024, 1, 1), 91.5)]
    files.append_rates_csv(r, spark.createDataFrame([("RUB", "USD", dt.date(2024, 1, 1), 1.0), ("RUB", "USD", dt.date(2024, 1, 2), 92.0)], r.schema), f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out").count() == 1
    (tmp_path / "r.xml").write_text('<ValCurs><Record Date="08.02.2024" Id="R01235"><Nominal>1</Nominal><Value>90,5</Value></Record><Record Date="08.02.2024" Id="X"><Nominal>1</Nominal><Value>1</Value></Record></ValCurs>')
    assert rows(files.read_rates_xml(spark, f"file://{tmp_path}/r.xml"), "target") == [("USD", "RUB", dt.date(2024, 2, 8), 0.011), ("RUB", "USD", dt.date(2024, 2, 8), 90.5)]


def test_forward_fill_and_as_of(spark):
    r = spark.createDataFrame([("RUB", "USD", dt.date(2024, 1, 1), 90.0), ("RUB", "USD", dt.date(2024, 1, 1), 92.0), ("RUB", "USD", dt.date(2024, 1, 4), 95.0), ("RUB", "USD", None, 1.0)], "base string, target string, date date, value double")
    filled = rates.fill_calendar(rates.daily_mean(r))
    assert [(x.date.day, x.value) for x in filled.orderBy("date").collect()] == [(1, 91.0), (2, 91.0), (3, 91.0), (4, 95.0)]
    q = spark.createDataFrame([("USD", dt.date(2023, 12, 31)), ("USD", dt.date(2024, 1, 3)), ("USD", dt.date(2025, 1, 1)), ("RUB", dt.date(2020, 1, 1)), ("EUR", dt.date(2024, 1, 2))], "c string, d date")
    assert {(x.c, x.d.isoformat()): x.rate for x in rates.as_of_rates(q, r, "c", "d").collect()} == {("USD", "2023-12-31"): None, ("USD", "2024-01-03"): 91.0, ("USD", "2025-01-01"): 95.0, ("RUB", "2020-01-01"): 1.0, ("EUR", "2024-01-02"): None}


def export(path, chat, ids):
    path.write_text(json.dumps({"id": chat, "name": "n", "messages": [{"id": i, "date": "2024-01-05T10:00:00", "text_entities": [{"type": "hashtag", "text": "#job"}, {"type": "blink", "text": "x"}]} for i in ids]}))


def test_chat_files(spark, tmp_path):
    export(tmp_path / "a.json", 5, [1, 2])
    (tmp_path / "skip.txt").write_text("no")
    m = files.chat_messages(files.read_chats(spark, f"file://{tmp_path}"))
    got = m.orderBy("telegram_message_id").collect()
    assert [(r.telegram_chat_id, r.telegram_message_id) for r in got] == [(5, 1), (5, 2)]
    assert [e.type for e in got[0].text_entries] == ["hashtag", "other"]
    (tmp_path / "map.jsn").write_text('{"channels": [{"chatId": 5, "channel": "c", "stack": " .NET "}]}')
    assert rows(files.read_stack_mapping(spark, f"file://{tmp_path}/map.jsn"), "chat_id") == [(5, "c", " .NET ")]


def test_stream_imports_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    export(src / "a.json", 5, [1, 2])
    for _ in range(2):
        import_stream(spark, f"file://{src}", f"file://{tmp_path}/store", f"file://{tmp_path}/cp").awaitTermination()
    export(src / "b.json", 5, [2, 3])
    import_stream(spark, f"file://{src}", f"file://{tmp_path}/store", f"file://{tmp_path}/cp").awaitTermination()
    posts = {r.telegram_message_id: r.deliveries for r in PostStore(spark, f"file://{tmp_path}/store").posts().collect()}
    assert posts == {1: 1, 2: 2, 3: 1}
    assert counts_stream(spark, f"file://{src}").isStreaming


def test_json_and_locales(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, float("inf"))], "i int, v double")
    assert [json.loads(r.json) for r in files.finite_json(df).collect()] == [{"i": 1}, {"i": 2, "v": 5.0}, {"i": 3}]
    assert files.nested({"ui.a.b": "x", "ui.a.c": "y", "k": "z"}) == {"a": {"b": "x", "c": "y"}}
    with pytest.raises(Exception):
        files.read_stack_mapping(spark, "file:///nowhere/map.json").count()


def test_missing_names(spark):
    held = spark.createDataFrame([("C#",), (".NET",)], "name string")
    assert rows(merge.missing_names(held, spark.createDataFrame([(" c# ",), ("Go",), ("GO",), ("",), (None,)], "name string")), "name") == [("go",)]
    assert spark.range(1).select(F.lit(1)).count() == 1
