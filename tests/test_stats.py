import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobforge.operators import combine, outliers, salary, stats
from jobforge.operators.quantiles import quantiles

S = "id int, ad_id int, date date, level int, lo double, hi double"
D = dt.date(2024, 1, 5)


def sal(spark, rows):
    return spark.createDataFrame([(i, i, D, lv, float(a), float(b)) for i, (lv, a, b) in enumerate(rows)], S)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50])
def test_quantiles_are_type_8(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (math.nan,)], "v double")
    got = quantiles(df, [], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert got.n == n
    for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
        assert got[name] == pytest.approx(np.quantile(v, q, method="median_unbiased"))


def test_quantile_example(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert quantiles(df, [], F.col("v"), {"a": 0.25}).first().a == pytest.approx(1.4166666667)
    assert quantiles(df.limit(0), [], F.col("v"), {"a": 0.25}).count() == 0


def test_fence_is_inclusive_and_zero_is_outside(spark):
    assert outliers.remove(sal(spark, [(3, 5, 5)] * 5)).count() == 0
    rows = [(3, x, x + 1) for x in (90, 95, 100, 105, 110)]
    assert outliers.remove(sal(spark, [*rows, (3, 0, 100)])).count() == 5
    assert outliers.remove(sal(spark, [(3, 0, 0)] * 3)).count() == 3
    assert outliers.remove(sal(spark, [*rows, (3, math.nan, 100)])).count() == 6


def test_small_and_unknown_levels_bypass(spark):
    rows = [(2, 100 + i, 200 + i) for i in range(13)]
    assert outliers.remove_by_level(sal(spark, [*rows, (2, 1e9, 1e9)])).count() == 14
    assert outliers.remove_by_level(sal(spark, [*rows, (2, 113, 213), (2, 1e9, 1e9)])).count() == 14
    assert outliers.remove_by_level(sal(spark, [(0, 100 + i, 200) for i in range(20)] + [(0, 1e9, 1e9)])).count() == 21


def test_nan_sorts_last_and_midpoints(spark):
    df = spark.createDataFrame([("a", math.nan), ("b", 1.0), ("c", 2.0)], "stack string, median double")
    assert [r.stack for r in stats.sorted_by_median(df).orderBy("rank").collect()] == ["c", "b", "a"]
    got = [r.m for r in sal(spark, [(1, 2, 4), (1, math.nan, 4), (1, 2, math.nan), (1, math.nan, math.nan)]).orderBy("id").select(stats.midpoint().alias("m")).collect()]
    assert got[:3] == [3.0, 4.0, 2.0] and math.isnan(got[3])


def test_histogram_keeps_empty_buckets(spark):
    h = {r.bucket: (r.n, r.percent) for r in stats.histogram(sal(spark, [(1, 1, 1), (1, 5e4, 5e4), (1, 9e9, 9e9), (1, math.nan, math.nan)])).collect()}
    assert len(h) == 7 and h["0-50k"] == (1, pytest.approx(33.333333)) and h["200k-250k"] == (0, 0.0) and h["300k+"][0] == 1


def test_monthly_share_rounds_half_even(spark):
    rows = [(D, 1)] * 49 + [(D, 2)] * 351 + [(D, 0)] * 5
    got = {r.category: r.percent for r in stats.monthly_share(spark.createDataFrame(rows, "date date, location int"), "location", stats.LOCATIONS).collect()}
    assert got["Russia"] == 12.2 and got["Us"] == 0.0 and len(got) == 7


def test_weighted_median_padding_and_steps(spark):
    df = spark.createDataFrame([(2020, 1.0, 1), (2020, 2.0, 1), (2020, 3.0, 5), (2022, 9.0, 2)], "year int, v double, w int")
    assert {r.year: r.weighted_median for r in combine.weighted_median(df, ["year"], "v", "w").collect()} == {2020: 3.0, 2022: 9.0}
    y = spark.createDataFrame([(2020, 4), (2022, 5)], "year int, n int")
    assert [tuple(r) for r in combine.padded_years(y, "year", "n", 2023).orderBy("year").collect()] == [(2020, 4), (2021, 0), (2022, 5), (2023, 0)]
    assert [r[0] for r in spark.createDataFrame([(90.0,), (400.0,)], "t double").select(combine.nice_step(F.col("t"))).collect()] == [20.0, 100.0]


def test_salary_states_and_text_parser(spark):
    raw = [(1, D, 1, 200.0, 100.0, 2), (2, D, 3, -1.0, 50.0, 1), (3, D, 0, 1.0, 2.0, 2), (4, D, 1, 1.0, 2.0, 3), (5, dt.date(1999, 1, 1), 1, 1.0, 2.0, 2), (6, D, 2, math.nan, None, 2)]
    rates = spark.createDataFrame([("RUB", "USD", dt.date(2024, 1, 1), 90.0), ("RUB", "USD", dt.date(2024, 1, 9), 91.0)], "base string, target string, date date, value double")
    got = {r.id: (r.lower, r.upper, r.status) for r in salary.normalize(spark.createDataFrame(raw, "id int, date date, currency int, lower_bound double, upper_bound double, period int"), rates).collect()}
    assert got == {1: (9000.0, 18000.0, 2), 2: (50.0, 50.0, 2), 3: (0.0, 0.0, 3), 4: (0.0, 0.0, 4), 5: (0.0, 0.0, 2), 6: (0.0, 0.0, 3)}
    texts = spark.createDataFrame([("invalid text",), ("",), ("100k-120k $",), ("100k-120k €",), ("до 50k ₽",)], "t string")
    p = [tuple(r) for r in texts.select(*salary.parse_text(F.col("t"))).collect()]
    assert p[0][0] == 0 and math.isnan(p[0][1]) and p[2] == (1, 100000.0, 120000.0) and p[3][0] == 2 and math.isnan(p[4][1]) and p[4][2] == 50000.0
