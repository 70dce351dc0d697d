"""Exact quantiles (Hyndman-Fan type 8) that bring neither a group's rows nor its distinct values to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins a unit of log(1 + |value|): a bin is 0.012 % wide, and a group has at most 6,000,000 of them over all doubles, a few thousand over money.
BINS = 1 << 13


def _bin(v: Column) -> Column:
    """A coarse value that never falls while ``v`` rises."""
    b = F.floor(F.log1p(F.abs(v)) * BINS)
    return F.when(v < 0, -b).otherwise(b).cast("long")


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    """h of type 8, and the two ranks between which it lies, held to the first and the last."""
    h = (n + 1 / 3) * F.lit(q) + 1 / 3
    k = F.floor(h)
    held = lambda r: F.least(F.greatest(r, F.lit(1).cast("long")), n)
    return h, held(k), held(k + 1)


def quantiles(df: DataFrame, groups: list[str], value: Column, qs: dict[str, float]) -> DataFrame:
    """One row per group with ``n`` and a column for each name in ``qs``; null and NaN values are left out, groups without values give no row.

    Equal values are counted first, with partial aggregation, and then bins of values. Running sums over a group's bins say which few bins hold the ranks
    asked for; only the values of those are ranked, each bin by itself. Type 8: h = (n + 1/3) q + 1/3; x[floor h] + (h - floor h) (x[floor h + 1] -
    x[floor h]), held to the first and last value."""
    counted = df.select(*groups, value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))  # over bins, not over rows
    bins = counted.groupBy(*groups, _bin(F.col("_v")).alias("_b")).agg(F.sum("_c").alias("_s"))
    bins = bins.withColumn("_n", F.sum("_s").over(own)).withColumn("_upto", F.sum("_s").over(own.orderBy("_b")))
    ranks = [r for q in qs.values() for r in _ranks(F.col("_n"), q)[1:]]
    wanted = reduce(lambda a, b: a | b, [(F.col("_upto") >= r) & (F.col("_upto") - F.col("_s") < r) for r in ranks])
    picked = bins.filter(wanted).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_b").alias("_pb"), "_n", (F.col("_upto") - F.col("_s")).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], _bin(F.col("_v")) == F.col("_pb"))
    within = Window.partitionBy(*groups, "_pb").orderBy("_v")
    ranked = counted.join(picked, same).withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
    aggs = [F.first("_n").alias("n")]
    for name, q in qs.items():
        _, a, b = _ranks(F.col("_n"), q)
        at = lambda r: F.min(F.when(F.col("_upto") >= r, F.col("_v")))
        aggs += [at(a).alias(f"_a_{name}"), at(b).alias(f"_b_{name}")]
    g = ranked.groupBy(*groups).agg(*aggs) if groups else ranked.groupBy().agg(*aggs).filter("n IS NOT NULL")
    out = [F.col(c) for c in groups] + [F.col("n")]
    for name, q in qs.items():
        h, k, _ = _ranks(F.col("n"), q)
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        out.append(F.when((F.floor(h) < 1) | (F.floor(h) >= F.col("n")), a).otherwise(a + (h - k) * (b - a)).alias(name))
    return g.select(*out)


QUARTILES = {"q1": 0.25, "q3": 0.75}
DECILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
