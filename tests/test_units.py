import datetime as dt

import pytest

from jobforge.operators import units

ADS = "id string, text string, extra int"
SAL = "id string, ad_id string, date date, currency int, lower_bound double, upper_bound double, period int, text string"
D = dt.date(2024, 5, 1)

CASES = [
    ("Зарплата от 230 тысяч мес. гросс. — Пересмотр дохода раз в 12 месяцев", 3, 230.0, 2, ("RUB", "month", 1000)),
    ("Зарплата от 230 тысяч руб. в месяц", 1, 230000.0, 1, ("RUB", "month", 1)),
    ("ЗП: 1\xa0100-1\xa0400 руб. часовая ставка до вычета налогов", 3, 1100.0, None, ("RUB", "hour", 1)),
    ("Pay from 22k USD per year net", 1, 22.0, 0, ("USD", "year", 1000)),
    ("Оплата: от 2 т. eur. участвовать в найме: 300", 2, 2000.0, 2, ("EUR", "month", 1)),
    ("Бюджет — от 0.345 млн р. гросс", 0, 0.345, 2, ("RUB", "month", 1000000)),
    ("Платим 720 - 1050 т. ₽ разово за проект", 3, 720.0, 3, ("RUB", "project", 1000)),
    ("Budget €3\xa0500 – 4\xa0900 per month gross", None, 4900.0, None, ("EUR", "month", 1)),
    ("💰 $4100 — 6100", None, 4100.0, 3, ("USD", "project", 1)),
    ("Зaрплата 100 - 120 $/день", None, 100.0, 2, ("USD", "day", 1)),
    ("Рекомендуйте друзей, премия 75 тысяч", 2, 75.0, 1, ("EUR", "day", 1)),
]


@pytest.mark.parametrize("text,currency,value,period,expected", CASES)
def test_recorded_unit(spark, text, currency, value, period, expected):
    ads = spark.createDataFrame([("a", text, 1)], ADS)
    s = spark.createDataFrame([("s", "a", D, currency, value, None, period, "clash")], SAL)
    r = units.recorded_units(s, ads).collect()
    assert [(x.currency, x.period, x.scale) for x in r] == [expected]


def test_unusable_rows_doubles_and_silence(spark):
    ads = spark.createDataFrame([("a", None, 1), ("b", "", 1)], ADS)
    rows = [("s1", "a", D, None, v, None, None, "") for v in (None, float("nan"), -1.0, 0.0, float("inf"))]
    rows += [("s2", "b", D, 2, 5.0, None, 1, "")] * 2 + [("s3", "gone", None, None, 7.0, None, None, None), ("s4", None, None, 0, 7.0, None, 0, None)]
    got = {x.salary_id: (x.currency, x.period, x.scale) for x in units.recorded_units(spark.createDataFrame(rows, SAL), ads).collect()}
    assert got == {"s2": ("EUR", "day", 1), "s3": ("RUB", "month", 1), "s4": ("RUB", "month", 1)}
    assert units.recorded_units(spark.createDataFrame(rows, SAL), ads).count() == 3
    assert units.recorded_units(spark.createDataFrame([], SAL), ads.limit(0)).count() == 0


def test_very_long_text(spark):
    ads = spark.createDataFrame([("a", "слово 5 " * 50_000 + "Доход 3к баксов/мес", 1)], ADS)
    s = spark.createDataFrame([("s", "a", D, 3, 3.0, None, 1, "")], SAL)
    assert [(x.currency, x.period, x.scale) for x in units.recorded_units(s, ads).collect()] == [("USD", "month", 1000)]
