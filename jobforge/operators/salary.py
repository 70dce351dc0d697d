"""Salary records: consistency of bounds, conversion to the base currency, and a deterministic text parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.functions.session import table
from jobforge.operators.rates import CURRENCY_NAMES, daily_mean, fill_calendar

NAN = float("nan")
#: Processing states.
ENRICHED, FAILED, SKIPPED = 2, 3, 4


def bound(c: Column) -> Column:
    """A bound as a number: null and the stored -1 mean none (NaN)."""
    return F.when(c.isNull() | (c == -1), F.lit(NAN)).otherwise(c)


def ordered_bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Swapped bounds change places; a missing one takes the other's value."""
    low = F.when(F.isnan(lo), hi).when(F.isnan(hi), lo).otherwise(F.least(lo, hi))
    high = F.when(F.isnan(hi), lo).when(F.isnan(lo), hi).otherwise(F.greatest(lo, hi))
    return low, high


def exact_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``rate`` of (currency, date): 1 for roubles, 0 where the filled calendar has no such day."""
    filled = fill_calendar(daily_mean(rates))
    name = F.create_map(*(F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv))
    keyed = df.withColumn("_cur", name[F.col("currency")])
    r = filled.select(F.col("target").alias("_cur"), "date", F.col("value").alias("_rate"))
    j = keyed.join(r, ["_cur", "date"], "left")
    return j.withColumn("rate", F.when(F.col("_cur") == "RUB", F.lit(1.0)).otherwise(F.coalesce("_rate", F.lit(0.0)))).drop("_cur", "_rate")


def normalize(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """(id, lower, upper, status) in roubles: skipped without a usable period (null, unknown, project), failed without a currency or any bound; else ordered
    bounds times the day's rate, rounded to four digits away from zero; a missing rate gives 0. Failed and skipped rows have bounds 0."""
    lo, hi = ordered_bounds(bound(F.col("lower_bound")), bound(F.col("upper_bound")))
    status = (
        F.when(F.coalesce(F.col("period"), F.lit(0)).isin(0, 3), F.lit(SKIPPED))
        .when(F.coalesce(F.col("currency"), F.lit(0)) == 0, F.lit(FAILED))
        .when(F.isnan(lo), F.lit(FAILED))
        .otherwise(F.lit(ENRICHED))
    )
    r = exact_rates(raw, rates).withColumn("new_status", status)
    done = F.col("new_status") == ENRICHED
    value = lambda v: F.when(done, F.round(v * F.col("rate"), 4)).otherwise(F.lit(0.0))
    return r.select("id", value(lo).alias("lower"), value(hi).alias("upper"), F.col("new_status").alias("status"))


def normalized(spark, sf_dir: str) -> DataFrame:
    """sal_normalized: all extractions anew, those doubled in full once."""
    s = table(spark, sf_dir, "salaries").select("id", "ad_id", "date", "currency", "lower_bound", "upper_bound", "period").distinct()
    return normalize(s, table(spark, sf_dir, "rates"))


def parse_text(text: Column) -> tuple[Column, Column, Column]:
    """(currency, lower, upper) of a short text: the currency by its sign; numbers may end in k; one number is both bounds, or the upper one after "до"; of two or more the first two, ordered."""
    cur = F.when(text.contains("$"), 1).when(text.contains("€"), 2).when(text.contains("₽"), 3).otherwise(0)
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+k?)"), F.lit(1))
    num = F.transform(found, lambda t: F.regexp_replace(t, "k", "").cast("double") * F.when(t.endswith("k"), 1000.0).otherwise(1.0))
    a, b = F.get(num, F.lit(0)), F.get(num, F.lit(1))
    nan = F.lit(NAN)
    one = F.size(num) == 1
    lower = F.when(F.size(num) >= 2, F.least(a, b)).when(one & F.lower(text).contains("до"), nan).when(one, a).otherwise(nan)
    upper = F.when(F.size(num) >= 2, F.greatest(a, b)).when(one, a).otherwise(nan)
    return cur, lower, upper
