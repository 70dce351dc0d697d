"""Two-tier outlier filters: Tukey fences on logarithms, over everything or per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.operators.quantiles import QUARTILES, quantiles

#: Fixed values.
TOLERANCE, FENCE, LEAST_ROWS, UNKNOWN_LEVEL = 1e-10, 1.5, 15, 0


def nonzero(c: Column) -> Column:
    """|c| > TOLERANCE; NaN and null are not."""
    return F.coalesce((F.abs(c) > TOLERANCE) & ~F.isnan(c), F.lit(False))


def fences(df: DataFrame, groups: list[str], bounds: tuple[str, ...]) -> DataFrame:
    """One row per group: the fences on ln of each bound from its non-zero values (null where it has none), in one pass over the rows."""
    long = df.select(*groups, F.inline(F.array(*(F.struct(F.lit(b).alias("_bound"), F.when(nonzero(F.col(b)), F.ln(b)).alias("_ln")) for b in bounds))))
    q = quantiles(long.filter("_ln IS NOT NULL"), [*groups, "_bound"], F.col("_ln"), QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    out = []
    for b in bounds:
        own = F.col("_bound") == b
        out += [F.max(F.when(own, F.col("q1") - FENCE * iqr)).alias(f"{b}_lo"), F.max(F.when(own, F.col("q3") + FENCE * iqr)).alias(f"{b}_hi")]
    return q.groupBy(*groups).agg(*out)


def outside(bound: str) -> Column:
    """On or beyond the fence; zero lies below any fence, NaN and null nowhere, and without a fence nothing is outside."""
    v, lo, hi = F.col(bound), F.col(f"{bound}_lo"), F.col(f"{bound}_hi")
    return F.coalesce(lo.isNotNull() & ~F.isnan(v) & ((v == 0) | (F.ln(v) <= lo) | (F.ln(v) >= hi)), F.lit(False))


def remove(df: DataFrame, groups: list[str] | None = None, bounds: tuple[str, str] = ("lo", "hi")) -> DataFrame:
    """Rows of which neither bound is outside the fences of its group (of all rows without ``groups``). Fences are a row per group and broadcast by size."""
    groups = groups or []
    f = fences(df, groups, bounds)
    out = df.join(f, groups, "left") if groups else df.join(F.broadcast(f), F.lit(True), "left")  # one row
    return out.filter(~(outside(bounds[0]) | outside(bounds[1]))).select(*df.columns)


def remove_by_level(df: DataFrame, level: str = "level", extra: list[str] | None = None) -> DataFrame:
    """``remove`` inside each level; levels with fewer than LEAST_ROWS rows and the unknown level are left as they are."""
    groups = [*(extra or []), level]
    size = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    sized = df.join(size, groups)
    small = (F.col("_size") < LEAST_ROWS) | (F.col(level) == UNKNOWN_LEVEL)
    kept = remove(sized.filter(~small), groups)
    return sized.filter(small).unionByName(kept).drop("_size").select(*df.columns)
