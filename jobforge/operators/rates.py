"""Daily currency rates: parsing, forward fill and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The currency integers of the data model.
CURRENCY_NAMES = {1: "USD", 2: "EUR", 3: "RUB"}


def daily_mean(rates: DataFrame) -> DataFrame:
    """One value per (target, day): the mean where a day occurs several times; rows without a usable value are left out."""
    ok = rates.filter("value > 0 AND NOT isnan(value) AND date IS NOT NULL AND target IS NOT NULL")
    return ok.groupBy("target", "date").agg(F.avg("value").alias("value"))


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Every day from a target's first to its last rate; a missing day takes the last earlier value. Grows with days, not with the data."""
    from pyspark.sql import Window

    w = Window.partitionBy("target").orderBy("date")
    until = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date"))
    return daily.withColumn("until", until).select("target", F.explode(F.sequence("date", "until")).alias("date"), "value")


def as_of_rates(df: DataFrame, rates: DataFrame, currency: str, day: str) -> DataFrame:
    """Add ``rate``, roubles for one unit of ``currency`` (USD, EUR, RUB): of the last day on or before ``day``; 1 for RUB, null before the first rate."""
    filled = fill_calendar(daily_mean(rates))
    last = filled.groupBy(F.col("target").alias(currency)).agg(F.max("date").alias("_last"))
    keyed = df.join(last, currency, "left").withColumn("_day", F.least(F.col(day), F.col("_last")))
    got = keyed.join(filled.select(F.col("target").alias(currency), F.col("date").alias("_day"), F.col("value").alias("_rate")), [currency, "_day"], "left")
    return got.withColumn("rate", F.when(F.col(currency) == "RUB", F.lit(1.0)).otherwise(F.col("_rate"))).drop("_last", "_day", "_rate")
