import datetime as dt

from jobforge.operators.delivery import PostStore, found, load_store, per_chat

M = "id string, telegram_chat_id long, telegram_message_id long, telegram_message_date timestamp, created_at timestamp, updated_at timestamp, part int, deliveries string"


def row(i, chat, msg, run, text="x"):
    t = dt.datetime(2024, run, 1, 3)
    return (i, chat, msg, t, t, t, 7, text)


def test_one_copy_across_batches_and_spellings(spark, tmp_path):
    store = PostStore(spark, f"file://{tmp_path}/s")
    first = [row("a", 17, 1, 1), row("b", 17, 1, 1), row("c", 18, 1, 1), row("n", 17, None, 1), row("m", None, 5, 1)]
    store.upsert(spark.createDataFrame(first, M))
    before = store._manifest()["parts"]
    got = store.upsert(spark.createDataFrame([row("d", -1000000000017, 1, 2), row("e", -18, 2, 2)], M))
    posts = {(r.telegram_chat_id, r.telegram_message_id): (r.id, r.deliveries) for r in store.posts().collect()}
    assert posts == {(17, 1): ("d", 3), (18, 1): ("c", 1), (18, 2): ("e", 1)}
    after = store._manifest()["parts"]
    assert got["rewritten"] == 2 and sum(before[p] != after[p] for p in before) <= got["rewritten"]
    assert all(n > 0 for _, n in after.values())
    assert store.upsert(spark.createDataFrame([], M)) == {"rewritten": 0, "kept": len(after)}
    assert store.index().count() == 3


def test_late_copy_goes_to_the_partition_that_holds_it(spark, tmp_path):
    store = PostStore(spark, f"file://{tmp_path}/s")
    store.upsert(spark.createDataFrame([row("a", 1, 1, 1), row("b", 1, 2, 1)], M))
    store.upsert(spark.createDataFrame([row("z", 1, 1, 9)], M))
    assert store.posts().count() == 2 and store.posts().filter("id = 'z'").count() == 1


def test_whole_table_hot_chat_and_empty(spark):
    rows = [row(f"r{i}", 5, i % 40, 1 + i % 3) for i in range(400)]
    store = load_store(spark, spark.createDataFrame(rows, M))
    assert store.posts().count() == 40 and store.posts().selectExpr("sum(deliveries)").first()[0] == 400
    assert load_store(spark, spark.createDataFrame([], M)).posts() is None


def test_posts_without_a_run_count(spark, tmp_path):
    def unrun(*r):
        x = row(*r)
        return (*x[:4], None, *x[5:])

    mixed = [row("a", 1, 1, 1), unrun("b", 1, 1, 1), unrun("c", 1, 2, 1), unrun("d", 1, 2, 2), row("e", 1, 3, 2), unrun("f", 1, None, 1)]
    for name, rows, want, chats in (
        ("mixed", mixed, {(1, 1), (1, 2)}, {(1, 3, 5, 1)}),
        ("none", [unrun("a", 1, 1, 1), unrun("b", 1, 1, 2), unrun("c", 2, 1, 2)], {(1, 1)}, {(1, 1, 2, 0), (2, 1, 1, 0)}),
        ("empty", [], set(), set()),
    ):
        spark.createDataFrame(rows, M).write.parquet(f"file://{tmp_path}/{name}/messages.parquet")
        assert {tuple(r) for r in found(spark, f"file://{tmp_path}/{name}").collect()} == want
        assert {tuple(r) for r in per_chat(spark, f"file://{tmp_path}/{name}").collect()} == chats


def months(n=24):
    return [(f"{c}-{k}", c, k, dt.datetime(2022 + k // 12, k % 12 + 1, 5), dt.datetime(2024, 1, 1), None, 7, "x") for k in range(n) for c in range(5)]


def test_a_late_batch_rewrites_a_small_share(spark, tmp_path):
    store = PostStore(spark, f"file://{tmp_path}/s")
    store.upsert(spark.createDataFrame(months(), M))
    late = [("late", 3, 7, dt.datetime(2025, 1, 1), dt.datetime(2024, 2, 1), None, 7, "y"), ("new", 9, 99, dt.datetime(2024, 1, 9), dt.datetime(2024, 2, 1), None, 7, "y")]
    assert store.upsert(spark.createDataFrame(late, M)) == {"rewritten": 2, "kept": 23}
    assert store.posts().count() == 121 and store.posts(["202208-0"]).filter("id = 'late' AND deliveries = 2").count() == 1


def test_a_crash_before_the_manifest_and_a_retry(spark, tmp_path, monkeypatch):
    from jobforge.operators import delivery

    store = PostStore(spark, f"file://{tmp_path}/s", small=0)
    store.upsert(spark.createDataFrame(months(3), M))
    again = [("z", 1, 1, dt.datetime(2022, 2, 5), dt.datetime(2024, 2, 1), None, 7, "y")]
    with monkeypatch.context() as m:
        m.setattr(delivery, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            store.upsert(spark.createDataFrame(again, M))
        except OSError:
            pass
    assert store.posts().filter("deliveries > 1").count() == 0
    store.upsert(spark.createDataFrame(again, M), stream="s", epoch=4)
    store.upsert(spark.createDataFrame(again, M), stream="s", epoch=4)  # a replayed batch
    assert [tuple(r) for r in store.posts().filter("deliveries > 1").select("id", "deliveries").collect()] == [("z", 2)]


def test_shares_of_a_month_merged_index_and_removed_versions(spark, tmp_path):
    store = PostStore(spark, f"file://{tmp_path}/s", part=4)
    for run in range(1, 9):
        store.upsert(spark.createDataFrame([row(f"r{run}-{i}", 5, run * 100 + i, 1) for i in range(10)] + [row("same", 5, 1, run)], M))
    m = store._manifest()
    assert store.posts().count() == 81 and [s[3] for s in m["index"]] == [1, 0, 0] and store.index().count() == 81
    assert store.posts().filter("id = 'same' AND deliveries = 8").count() == 1 and len(m["parts"]) >= 3
    folders = [n for n in __import__("os").listdir(f"{tmp_path}/s") if n.startswith("posts-")]
    assert len(folders) <= 4
