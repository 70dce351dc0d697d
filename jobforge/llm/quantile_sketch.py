"""Percentiles from dyadic count-sketches: mergeable by addition, open to deletions.

A value is encoded as one of 2**BITS codes on a logarithmic scale, so that a code's middle is within VALUE_ERROR of every value it stands for. There is
one signed sketch for each binary resolution of the codes: ROWS rows of WIDTH counters, each code prefix adding its count with a random sign to one counter a row.
Resolutions with no more prefixes than a row has counters are kept without collisions, one counter a prefix. A sketch is a table of counters, sparse and as large
as its groups, never as large as the data; sketches of days, files or partitions merge by summing counters, and a row is taken back with weight -1.
A quantile descends from the root: at each resolution the estimated count of the left half, held between 0 and its parent's, says which half holds the rank.

A group with no more than EXACT different codes is kept as counts of codes (shift RAW), which is less than its sketch would take. Sketches are linear, so
codes can be spread into a sketch at any time: ``merge`` does so where a group outgrows EXACT or meets a sketch, and the counters are those of a
sketch made in one go.

Bound: a row's estimate of a prefix has a variance of at most F2 / WIDTH, F2 being the sum of the squared counts at that resolution, so by Chebyshev it is off by more than
K sqrt(F2 / WIDTH) with probability 1 / K**2 at most, and the median of ROWS independent rows with C(ROWS, h) / K**(2 h), h = (ROWS + 1) / 2. K is the least for which
the estimates of a descent through all sketched resolutions fail with probability DELTA at most; the rank of the answer is then within
``rank_error``, the sum of K sqrt(F2 / WIDTH) over the resolutions, of the one asked for. F2 is taken from the sketch itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobforge.functions.session import cut, table

BITS, ROWS, WIDTH, EXACT, RAW = 16, 7, 2048, 256, -1
BASE, STEP = 1e-3, 0.001
#: Relative error of a decoded value, for values from BASE to about 1e25.
VALUE_ERROR = math.sqrt(1 + STEP) - 1
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
#: Resolutions (bits dropped) that are sketched; coarser ones are exact.
SKETCHED = [s for s in range(BITS) if 1 << (BITS - s) > WIDTH]
COUNTERS = ["shift", "row", "bucket"]
#: Probability with which a percentile's rank may be off by more than its rank_error, and the number of deviations that follows.
DELTA = 0.01
K = (len(SKETCHED) * math.comb(ROWS, (ROWS + 1) // 2) / DELTA) ** (1 / (ROWS + 1))


def encode(v: Column) -> Column:
    """The code of a positive number."""
    return F.least(F.greatest(F.floor(F.ln(v / BASE) / math.log1p(STEP)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("int")


def decode(code: int) -> float:
    """The (geometric) middle of a code."""
    return BASE * math.exp((code + 0.5) * math.log1p(STEP))


def _bucket(prefix: Column, shift: int, row: int) -> Column:
    return F.pmod(F.xxhash64(prefix, F.lit(shift), F.lit(row)), F.lit(WIDTH)).cast("int")


def _sign(prefix: Column, shift: int, row: int) -> Column:
    return F.when(F.xxhash64(F.lit(row), prefix, F.lit(shift)) < 0, F.lit(-1)).otherwise(F.lit(1))


def sketch(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Counters (groups, shift, row, bucket, count) of ``value`` in each group. Null, NaN, infinite, zero and negative values aren't counted.

    Equal codes are counted first, so the spreading over resolutions works on distinct codes, of which a group has at most 2**BITS."""
    v = F.col(value).cast("double")
    ok = df.filter(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))
    counted = ok.groupBy(*groups, encode(v).alias("code")).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("count"))
    return merge(counted.select(*groups, F.lit(RAW).alias("shift"), F.lit(0).alias("row"), F.col("code").alias("bucket"), "count"), groups)


def spread(codes: DataFrame, groups: list[str]) -> DataFrame:
    """The counters of counts of codes (groups, bucket, count): a cell for each resolution, and for each row of a sketched one."""
    cells = []
    for s in range(BITS + 1):
        prefix = F.shiftright("bucket", s)
        for r in range(ROWS if s in SKETCHED else 1):
            bucket, sign = (_bucket(prefix, s, r), _sign(prefix, s, r)) if s in SKETCHED else (prefix, F.lit(1))
            cells.append(F.struct(F.lit(s).alias("shift"), F.lit(r).alias("row"), bucket.alias("bucket"), (sign * F.col("count")).alias("count")))
    return codes.select(*groups, F.inline(F.array(*cells)))


def merge(counters: DataFrame, groups: list[str]) -> DataFrame:
    """Add counters up per group; with fewer groups than the counters have, that merges sketches. Counters of 0 go."""
    added = counters.groupBy(*groups, *COUNTERS).agg(F.sum("count").cast("long").alias("count"))
    own = Window.partitionBy(*groups)  # over the counters of a group, which are bounded
    many = (F.max("shift").over(own) > RAW) | (F.sum((F.col("shift") == RAW).cast("int")).over(own) > EXACT)
    sized = added.withColumn("_many", many)
    loose = sized.filter((F.col("shift") == RAW) & F.col("_many")).drop("_many")
    rest = sized.filter((F.col("shift") != RAW) | ~F.col("_many")).drop("_many")
    made = rest.filter(F.col("shift") != RAW).unionByName(spread(loose, groups)).groupBy(*groups, *COUNTERS).agg(F.sum("count").cast("long").alias("count"))
    return rest.filter(F.col("shift") == RAW).unionByName(made).filter(F.col("count") != 0)


def minus(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of a's rows without b's (b's must be among a's)."""
    return merge(a.unionByName(b.withColumn("count", -F.col("count"))), groups)


def quantiles(counters: DataFrame, groups: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(groups, q, value, n, rank_error): the value of rank ceil(q n), and by how many ranks it may be off, but for the probability DELTA; 0 for a
    group kept in codes. A group without counted values gives no row."""
    spark = counters.sparkSession
    hashes = _hash_tables(spark)

    def from_codes(codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
        order = np.argsort(codes)
        upto = np.cumsum(counts[order])
        n = int(upto[-1]) if len(upto) else 0
        return [(q, decode(int(codes[order][np.searchsorted(upto, max(1, math.ceil(q * n)))])), n, 0.0) for q in qs] if n > 0 else []

    def from_sketch(pdf: pd.DataFrame) -> list[tuple]:
        cells = {s: np.zeros((ROWS, WIDTH) if s in SKETCHED else (1, max(1, 1 << (BITS - s))), np.int64) for s in range(BITS + 1)}
        for s, part in pdf.groupby("shift"):
            cells[s][part["row"].to_numpy(), part["bucket"].to_numpy()] = part["count"].to_numpy()
        n = int(cells[BITS][0, 0])
        if n <= 0:
            return []
        error = sum(K * math.sqrt(float(np.median((cells[s].astype(float) ** 2).sum(axis=1))) / WIDTH) for s in SKETCHED)

        def count(s: int, prefix: int) -> float:
            if s not in SKETCHED:
                return float(cells[s][0, prefix])
            bucket, sign = hashes[s]
            return float(np.median([cells[s][r, bucket[r, prefix]] * sign[r, prefix] for r in range(ROWS)]))

        out = []
        for q in qs:
            rank, node, held = max(1, math.ceil(q * n)), 0, float(n)
            for s in range(BITS - 1, -1, -1):
                left = min(max(count(s, 2 * node), 0.0), held)
                if rank <= left:
                    node, held = 2 * node, left
                else:
                    rank, node, held = rank - left, 2 * node + 1, held - left
            out.append((q, decode(node), n, error))
        return out

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = (pdf["shift"] == RAW).to_numpy()
        out = from_codes(pdf["bucket"].to_numpy(), pdf["count"].to_numpy()) if raw.all() else from_sketch(pdf[~raw])
        got = pd.DataFrame(out, columns=["q", "value", "n", "rank_error"])
        for g in groups:
            got[g] = [pdf[g].iloc[0]] * len(got)
        return got[[*groups, "q", "value", "n", "rank_error"]]

    kinds = ", ".join(f"{g} {counters.schema[g].dataType.simpleString()}" for g in groups)
    return counters.groupBy(*groups).applyInPandas(invert, f"{kinds}, q double, value double, n long, rank_error double")


def _hash_tables(spark: SparkSession) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bucket and sign of every prefix of every sketched resolution, by the functions that built the sketch (a table of fixed size)."""
    out = {}
    for s in SKETCHED:
        p = F.col("id").cast("int")
        cols = [_bucket(p, s, r).alias(f"b{r}") for r in range(ROWS)] + [_sign(p, s, r).alias(f"s{r}") for r in range(ROWS)]
        t = spark.range(1 << (BITS - s)).coalesce(1).select(*cols).toPandas()
        out[s] = (t[[f"b{r}" for r in range(ROWS)]].to_numpy(np.int16).T.copy(), t[[f"s{r}" for r in range(ROWS)]].to_numpy(np.int8).T.copy())
    return out


def bounds(salaries: DataFrame, day: str = "MM") -> DataFrame:
    """(level, month, bound, v): both normalised bounds of each row, doubled ones once; ``month`` is the date cut to ``day`` (MM, DD)."""
    rows = salaries.select("id", "level", F.to_date(F.date_trunc(day, "date")).alias("month"), "lower_bound_normalized", "upper_bound_normalized").distinct()
    return rows.select("level", "month", F.inline(F.array(*(F.struct(F.lit(n).alias("bound"), F.col(f"{n}_bound_normalized").alias("v")) for n in ("lower", "upper")))))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_percentiles: percentiles of both bounds by level, over each month and, from the merged months, over all time (month null); 0 marks failed rows
    and isn't counted."""
    months = cut(sketch(bounds(table(spark, sf_dir, "salaries")), ["level", "month", "bound"], "v"), "sketches")
    ever = merge(months, ["level", "bound"]).withColumn("month", F.lit(None).cast("date"))
    return quantiles(months.unionByName(ever), ["level", "month", "bound"])


def merged_and_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_merged: by level and bound, from the merged sketches of days less those of 2024: the rows counted, and how many counters differ from those of a
    sketch that was made from the rows of the other years in one go."""
    groups = ["level", "bound"]
    rows = bounds(table(spark, sf_dir, "salaries"), "DD")
    days = merge(cut(sketch(rows, ["level", "month", "bound"], "v"), "sketches").drop("month"), groups)
    year = F.year("month") == 2024
    left = minus(days, sketch(rows.filter(year), groups, "v"), groups)
    anew = sketch(rows.filter(~year), groups, "v")
    # a sketch from which rows were taken may have grown beyond EXACT before: both are compared as sketches
    whole = lambda df: spread(df.filter(F.col("shift") == RAW), groups).unionByName(df.filter(F.col("shift") != RAW))
    both = whole(left).unionByName(whole(anew).withColumn("count", -F.col("count"))).groupBy(*groups, *COUNTERS).agg(F.sum("count").alias("off"))
    off = both.groupBy(*groups).agg(F.sum((F.col("off") != 0).cast("long")).alias("differing"))
    n = whole(left).filter(F.col("shift") == BITS).groupBy(*groups).agg(F.sum("count").alias("n"))
    return n.join(off, groups)


MERGED_SQL = """WITH r AS (SELECT DISTINCT id, level, date, lower_bound_normalized AS l, upper_bound_normalized AS u FROM salaries), v AS (SELECT level, date, 'lower' AS bound, l AS v FROM r UNION ALL SELECT level, date, 'upper', u FROM r)
SELECT level, bound, count(*) AS n, 0::BIGINT AS differing FROM v WHERE v > 0 AND CAST(v AS VARCHAR) NOT IN ('nan', 'inf') AND year(date) <> 2024 GROUP BY ALL"""
