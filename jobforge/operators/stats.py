"""Counts, shares, histograms and percentiles over salaries and ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobforge.functions.session import cut, guid, table
from jobforge.operators import outliers
from jobforge.operators.outliers import nonzero
from jobforge.operators.quantiles import DECILES, quantiles

#: Histogram buckets (label, from, to), names of levels, locations and work formats.
BUCKETS = [("0-50k", 0.0, 5e4), ("50k-100k", 5e4, 1e5), ("100k-150k", 1e5, 1.5e5), ("150k-200k", 1.5e5, 2e5), ("200k-250k", 2e5, 2.5e5), ("250k-300k", 2.5e5, 3e5), ("300k+", 3e5, 1.7976931348623157e308)]
LEVELS = ["Unknown", "Intern", "Junior", "Middle", "Senior", "Lead", "Architect", "Manager"]
LOCATIONS = ["Unknown", "Russia", "Belarus", "Cis", "Europe", "Us", "MiddleEast", "Other"]
FORMATS = ["Unknown", "OnSite", "Hybrid", "RemoteDomestic", "RemoteWorldwide"]
TOP_STACKS, LEAST_JOBS = 30, 5


def names(c: Column, labels: list[str]) -> Column:
    """An enumeration's label; null where the number has none."""
    return F.create_map(*(F.lit(x) for i, n in enumerate(labels) for x in (i, n)))[c]


def salaries(spark, sf_dir: str) -> DataFrame:
    """One row per extraction: id, ad_id, date, level, lo, hi (normalised bounds; NaN kept). Rows doubled in full count once, negative bounds are refused."""
    s = table(spark, sf_dir, "salaries").select("id", "ad_id", "date", "level", F.col("lower_bound_normalized").alias("lo"), F.col("upper_bound_normalized").alias("hi")).distinct()
    return s.filter("(lo >= 0 OR isnan(lo)) AND (hi >= 0 OR isnan(hi))")


def ads(spark, sf_dir: str) -> DataFrame:
    """Ads with the stack's id in canonical form."""
    return table(spark, sf_dir, "ads").withColumn("stack_id", guid(F.col("stack_id")))


def steady(c: Column) -> Column:
    """Three digits. A nudge well above the noise of summation takes values off the middle, so that sums made in another order round alike."""
    return F.round(c + 1e-7, 3)


def before_month(df: DataFrame, as_of: str) -> DataFrame:
    """Rows dated before the first day of ``as_of``'s month."""
    return df.filter(F.col("date") < F.trunc(F.lit(as_of).cast("date"), "MM"))


def midpoint() -> Column:
    """Mean of the bounds; the other one where one is NaN, NaN where both are."""
    lo, hi = F.col("lo"), F.col("hi")
    return F.when(F.isnan(lo), hi).when(F.isnan(hi), lo).otherwise((lo + hi) / 2)


def positive(c: Column) -> Column:
    return ~F.isnan(c) & (c > 0)


def with_stacks(spark, sf_dir: str) -> DataFrame:
    """Salaries with the stack of their ad and its name (null where the ad has none); salaries without an ad fall out."""
    a = ads(spark, sf_dir).select(F.col("id").alias("ad_id"), "stack_id")
    t = table(spark, sf_dir, "technology_stacks").select(F.col("id").alias("stack_id"), F.col("name").alias("stack"))
    return salaries(spark, sf_dir).join(a, "ad_id").join(t, "stack_id", "left")


def count_by(df: DataFrame, unit: str) -> DataFrame:
    """Rows by "YYYY MM", "MM" or "YYYY"."""
    key = {"year_month": F.date_format("date", "yyyy MM"), "month": F.date_format("date", "MM"), "year": F.date_format("date", "yyyy")}[unit]
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def monthly_share(df: DataFrame, kind: str, labels: list[str]) -> DataFrame:
    """Share in percent (one digit, half to even) of each known kind in a month's known rows; a kind absent from a month has 0."""
    known = df.filter(F.col(kind) > 0).select(F.date_format("date", "yyyy MM").alias("key"), names(F.col(kind), labels).alias("category"))
    counts = known.groupBy("key", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = known.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    every = totals.select("key", "total", F.explode(F.array(*map(F.lit, labels[1:]))).alias("category"))
    return every.join(counts, ["key", "category"], "left").select("key", "category", F.bround(F.coalesce("n", F.lit(0)) * 100.0 / F.col("total"), 1).alias("percent"))


def yearly(global_kept: DataFrame, level_kept: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Per year (and group): extremes from one set of rows, mean and median of midpoints from the other; zero and NaN bounds don't count, years without any are absent."""
    g = [*(groups or []), "year"]
    y = F.year("date").alias("year")
    ext = global_kept.select(*(groups or []), y, "lo", "hi").groupBy(*g).agg(F.min(F.when(nonzero(F.col("lo")), F.col("lo"))).alias("min_lower"), F.max(F.when(nonzero(F.col("hi")), F.col("hi"))).alias("max_upper"))
    both = level_kept.filter(nonzero(F.col("lo")) & nonzero(F.col("hi"))).select(*(groups or []), y, midpoint().alias("mid"))
    mean = both.groupBy(*g).agg(F.avg("mid").alias("mean"))
    median = quantiles(both, g, F.col("mid"), {"median": 0.5}).drop("n")
    out = ext.join(mean.join(median, g), g, "full")
    r = lambda c: steady(F.col(c)).alias(c)
    return out.select(*g, *map(r, ("min_lower", "max_upper", "mean", "median"))).filter("min_lower IS NOT NULL OR max_upper IS NOT NULL OR mean IS NOT NULL")


def hybrid_yearly(df: DataFrame) -> DataFrame:
    """The hybrid rule: extremes from rows kept by the global filter, mean and median from rows kept inside their level."""
    rows = cut(df, "salaries")  # read by both tiers
    return yearly(outliers.remove(rows), outliers.remove_by_level(rows))


def histogram(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Midpoints by bucket: count and percent of all midpoints that are numbers; empty buckets are kept."""
    g = groups or []
    m = df.select(*g, midpoint().alias("mid")).filter(~F.isnan("mid"))
    sums = [F.sum(F.when((F.col("mid") >= a) & (F.col("mid") < b), 1).otherwise(0)).alias(f"_b{i}") for i, (_, a, b) in enumerate(BUCKETS)]
    s = m.groupBy(*g).agg(F.count(F.lit(1)).alias("_t"), *sums).filter("_t > 0")
    rows = F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"_b{i}").cast("long").alias("n"), F.round(F.col(f"_b{i}") * 100.0 / F.col("_t"), 6).alias("percent")) for i, (n, _, _) in enumerate(BUCKETS)))
    return s.select(*g, F.inline(rows))


def aggregate_statistics(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Per group: number of midpoints (zeros count), mean, median and four more quantiles."""
    g = groups or []
    m = df.select(*g, midpoint().alias("mid")).filter(~F.isnan("mid"))
    q = quantiles(m, g, F.col("mid"), DECILES)
    mean = m.groupBy(*g).agg(F.avg("mid").alias("mean"))
    j = q.join(mean, g) if g else q.join(F.broadcast(mean), F.lit(True))  # one row each
    return j.select(*g, "n", *(steady(F.col(c)).alias(c) for c in ("mean", *DECILES)))


def top_stacks(df: DataFrame, most: int = TOP_STACKS, least: int = LEAST_JOBS) -> DataFrame:
    """Stacks by falling number of rows, ties by name: at most ``most``, each with ``least`` rows or more."""
    c = df.filter("stack IS NOT NULL").groupBy("stack").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return c.orderBy(F.desc("n"), "stack").limit(most)


def stack_summary(df: DataFrame) -> DataFrame:
    """Top stacks with their share in percent of all rows, those without a stack included."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return top_stacks(df).join(F.broadcast(total), F.lit(True)).select("stack", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # total: one row


def stack_comparison(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: all rows counted, quantiles over positive midpoints (NaN where there are none)."""
    mid = midpoint()
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("jobs"))
    q = quantiles(df.withColumn("mid", mid).filter(positive(F.col("mid"))), groups, F.col("mid"), DECILES).drop("n")
    nan = F.lit(float("nan"))
    return counts.join(q, groups, "left").select(*groups, "jobs", *(F.coalesce(steady(F.col(c)), nan).alias(c) for c in DECILES))


def sorted_by_median(df: DataFrame) -> DataFrame:
    """Rank by falling median, NaN last, ties by stack."""
    w = Window.orderBy(F.isnan("median"), F.desc("median"), "stack")  # over the top stacks: a report's rows
    return df.withColumn("rank", F.row_number().over(w))


def source_counts(spark, sf_dir: str, as_of: str) -> DataFrame:
    """Per chat: first and last day of its messages, messages, salaries and salaries of the last closed month; chats without messages fall out."""
    from jobforge.operators.delivery import plain_chat_id

    first = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -1)
    m = table(spark, sf_dir, "messages").select(F.col("id").alias("message_id"), plain_chat_id(F.col("telegram_chat_id")).alias("telegram_id"), F.to_date("telegram_message_date").alias("day"))
    per = m.groupBy("telegram_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("messages"))
    a = table(spark, sf_dir, "ads").select(F.col("id").alias("ad_id"), "message_id")
    j = salaries(spark, sf_dir).join(a, "ad_id").join(m.select("message_id", "telegram_id").distinct(), "message_id")
    s = j.groupBy("telegram_id").agg(F.count(F.lit(1)).alias("salaries"), F.sum(F.when(F.col("date").between(first, F.last_day(first)), 1).otherwise(0)).alias("last_month"))
    c = table(spark, sf_dir, "chats").select("telegram_id", F.lower(F.trim("name")).alias("name"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.join(per, "telegram_id").join(s, "telegram_id", "left").select("telegram_id", "name", "first_day", "last_day", "messages", zero("salaries"), zero("last_month"))
