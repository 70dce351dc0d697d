import datetime as dt

import pytest

from jobforge.functions.limits import AdaptiveLimit, is_quota, is_rate_limit, retry_after
from jobforge.plans import pipelines, reports


def test_pipelines(spark):
    assert pipelines.PIPELINES.list() == sorted(pipelines.PIPELINES.list())
    with pytest.raises(KeyError, match="update-levels"):
        pipelines.PIPELINES.run(["nope"], {})
    t = {
        "ads": spark.createDataFrame([("a", "m"), ("b", "n")], "id string, message_id string"),
        "messages": spark.createDataFrame([("m", ["#senior"]), ("n", [])], "id string, tags array<string>"),
        "salaries": spark.createDataFrame([("a", 0), ("a", 2), ("b", 0)], "ad_id string, level int"),
    }
    got = pipelines.PIPELINES.run(["Update-Levels"], t)["salaries"]
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("a", 4), ("b", 0)]


def test_places(spark):
    ads = spark.createDataFrame([("a", "гибрид, Минск", 0, 0), ("b", None, 0, 0), ("c", "гибрид", 1, 0), ("d", "  ", 0, 0)], "id string, text string, location int, work_format int")
    assert sorted((r.id, r.location, r.work_format) for r in pipelines.classify_places(ads).collect()) == [("a", 2, 2), ("b", 0, 0), ("c", 1, 0), ("d", 0, 0)]


def test_limit():
    now = [0.0]
    lim = AdaptiveLimit(start=5, most=6, clock=lambda: now[0])
    for _ in range(10):
        lim.report(True)
    assert lim.limit == 6
    lim.report(False, "429: try again in 200ms")
    assert lim.limit == 4 and lim.wait() == pytest.approx(1.2)
    for _ in range(5):
        lim.report(False, "boom")
    assert lim.limit == 2
    with lim if not (now.__setitem__(0, 99.0)) else lim:
        assert lim.used == 1
    assert lim.used == 0 and is_rate_limit("rate_limit_exceeded") and is_quota("insufficient_quota")
    assert retry_after("try again in 2 m") == 30.0 and retry_after("no") is None


def test_charts_and_pages(tmp_path):
    rows = [{"series": "All", "key": "2024", "value": 1.0}, {"series": "All", "key": "2025", "value": float("nan")}, {"series": "Senior", "key": "2025", "value": 3.0}]
    c = reports.chart(rows)
    assert c["labels"] == ["2024", "2025"] and c["datasets"][1]["data"] == [0, 3.0]
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    meta = reports.metadata("Site", "https://x.example/", ["en", "EN", "ru"], "ru", reports.published_at(str(tmp_path), now))
    assert list(meta["alternates"]) == ["ru", "en"] and reports.published_at(str(tmp_path), dt.datetime(2030, 1, 1)) == now
    (page,) = reports.write_html(str(tmp_path), now, {"c": c}, {"ru": {"title": "T", "c": "C"}}, meta)
    text = page.read_text()
    assert "20240506-070809Z" in str(page) and 'hreflang="en"' in text and "ld+json" in text and "NaN" not in text
    with pytest.raises(KeyError):
        reports.write_html(str(tmp_path), now, {"c": c}, {"ru": {"title": "T"}}, meta)
    assert reports.console("Top", [("a", 1)]).splitlines()[2] == "a" + " " * 19 + "1"
    assert reports.number(1234.0) == "1,234" and reports.number(1234.5) == "1,234.50"
