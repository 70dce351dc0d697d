"""Recombination of per-stack statistics, as a report's reader does it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobforge.operators.quantiles import DECILES


def include(df: DataFrame, stacks: list[str] | None = None, exclude: bool = False) -> DataFrame:
    """Rows of the chosen stacks, or of all others."""
    if not stacks:
        return df
    chosen = F.col("stack").isin(*stacks)
    return df.filter(~chosen if exclude else chosen)


def distributions(per_stack: DataFrame) -> DataFrame:
    """Sum of counts by bucket, shares anew."""
    s = per_stack.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # seven rows
    return s.select("bucket", "n", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 6)).otherwise(F.lit(0.0)).alias("percent"))


def averaged(per_stack: DataFrame) -> DataFrame:
    """Job-weighted means of medians and percentiles (not percentiles of the pooled rows), rounded half up."""
    w = F.sum("n")
    return per_stack.groupBy().agg(w.cast("long").alias("n"), *(F.floor(F.sum(F.col(c) * F.col("n")) / w + 0.5).cast("double").alias(c) for c in ("mean", *DECILES)))


def share(df: DataFrame, count: str = "n") -> DataFrame:
    """Each row's share in percent of the shown rows."""
    return df.withColumn("share", F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy(F.lit(1))), 6))  # the rows of a report


def weighted_median(df: DataFrame, groups: list[str], value: str, weight: str) -> DataFrame:
    """First value whose running weight reaches half of the group's."""
    own = Window.partitionBy(*groups)
    by_value = df.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    r = by_value.withColumn("_c", F.sum("_w").over(own.orderBy(value))).withColumn("_t", F.sum("_w").over(own))
    return r.filter(F.col("_c") >= F.col("_t") / 2).groupBy(*groups).agg(F.min(value).alias("weighted_median"))


def padded_years(df: DataFrame, year: str, value: str, to: int) -> DataFrame:
    """A row for every year from the first to the last or ``to``, 0 where there was none."""
    span = df.agg(F.min(year).alias("a"), F.greatest(F.max(year), F.lit(to)).alias("b"))
    years = span.select(F.explode(F.sequence("a", "b")).alias(year))
    return years.join(df, year, "left").select(year, F.coalesce(value, F.lit(0)).alias(value))


def nice_step(top: Column, ticks: int = 5) -> Column:
    """Axis step of 1, 2 or 5 times a power of ten for a maximum enlarged by a twentieth."""
    raw = top * 1.05 / ticks
    p = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / p
    return F.when(m <= 1, p).when(m <= 2, p * 2).when(m <= 5, p * 5).otherwise(p * 10)


def stable_hue(c: Column) -> Column:
    """Hue 0..359 of a name: h = 31 h + character code in 32 bits, modulo 360."""
    codes = F.transform(F.split(c, ""), lambda x: F.when(F.length(x) > 0, F.ascii(x)).otherwise(F.lit(0)).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), F.lit(360)).cast("int")


def search(df: DataFrame, part: str, by: str = "median", most: int = 5) -> DataFrame:
    """Stacks whose name contains a part, case aside, by falling ``by``, ties by name."""
    return df.filter(F.lower("stack").contains(part.lower())).orderBy(F.isnan(by), F.desc(by), "stack").limit(most)


def at_level(totals: DataFrame, per_level: DataFrame, level: int | None, key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """Figures of one level in the place of the totals: ``jobs`` 0 and NaN quantiles where the level is absent; without a level the totals themselves."""
    if level is None:
        return totals
    own = per_level.filter(F.col("level") == level).drop("level")
    j = totals.select(*key).join(own, list(key), "left")
    return j.select(*key, F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"), *(F.coalesce(c, F.lit(float("nan"))).alias(c) for c in DECILES))


def yearly_metric(points: DataFrame, metric: str) -> DataFrame:
    """(year, value) from points (year, median, mean, n): the largest or smallest median that is a number ("max", "min"), the mean weighted by n ("avg", null
    without weight), or the median weighted by n ("median")."""
    finite = F.when(~F.isnan("median"), F.col("median"))
    if metric in ("max", "min"):
        return points.groupBy("year").agg((F.max if metric == "max" else F.min)(finite).alias("value"))
    if metric == "avg":
        return points.groupBy("year").agg(F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("value"))
    return weighted_median(points.filter(~F.isnan("median")), ["year"], "median", "n").withColumnRenamed("weighted_median", "value")


def selector(df: DataFrame) -> DataFrame:
    """Stacks as a selector shows them: rank by falling number of jobs, ties by name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "stack")))  # the stacks of a report
