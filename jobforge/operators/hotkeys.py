"""Ordered per-key results where a few keys hold most rows: exact offset chunking.

Rows are range-partitioned by (key, order), so that a hot key spans as many partitions as it fills. Counting keys per partition and
prefix-summing those counts over partitions numbers every row exactly; numbers cut each key into chunks of equal size, a task works on
chunks, never on a whole key, and the chunks' ordered boundary states are merged into one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobforge.functions.session import cut, guid, num_partitions, table

CHUNK = 20_000


def number_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``row_no``, from 1 within each key in the order given, without bringing a key to one task. Null keys form a key of their own.

    The order must be total for numbers to be repeatable; equal rows take any of their numbers."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(num_partitions(spark), F.col(key), *map(F.col, order)).withColumn("_pid", F.spark_partition_id())
    held = cut(ranged, "ranged")
    counts = held.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition a key is in
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = held.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order)))
    o = offsets.withColumnRenamed("_pid", "_opid")
    return local.join(o, (local["_pid"] == o["_opid"]) & local[key].eqNullSafe(o["_key"])).withColumn("row_no", F.col("_local") + F.col("_offset")).drop("_pid", "_opid", "_key", "_local", "_offset")


def chunk_states(numbered: DataFrame, key: str, day: str, size: str, chunk: int = CHUNK) -> DataFrame:
    """One boundary state per (key, chunk): rows, sum of ``size``, first and last day, days, the longest gap in days within it."""
    within = Window.partitionBy(key, "chunk").orderBy("row_no")
    gap = F.datediff(F.col(day), F.lag(day).over(within))
    c = numbered.withColumn("chunk", F.floor((F.col("row_no") - 1) / chunk)).withColumn("_gap", gap)
    return c.groupBy(key, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.sum(F.when((F.col("_gap") > 0) | (F.col("_gap").isNull() & F.col(day).isNotNull()), 1).otherwise(0)).alias("days"),
        F.max("_gap").alias("gap"), F.max_by("_id", "row_no").alias("last_id"),
    )


def merge_states(states: DataFrame, key: str) -> DataFrame:
    """Fold the chunks of each key in order: a gap may lie between two chunks, and a day may lie on both sides of a boundary."""
    prev = Window.partitionBy(key).orderBy("chunk")
    last = F.last("last_day", True).over(prev.rowsBetween(Window.unboundedPreceding, -1))
    s = states.withColumn("_between", F.datediff("first_day", last)).withColumn("_twice", F.when(F.col("first_day") == last, 1).otherwise(0))
    return s.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.sum("total").alias("n_chars"), F.min("first_day").alias("first_date"), F.max("last_day").alias("latest_date"),
        (F.sum("days") - F.sum("_twice")).alias("n_days"), F.coalesce(F.greatest(F.max("gap"), F.max("_between")), F.lit(0)).alias("longest_gap"),
        F.count(F.lit(1)).alias("n_chunks"), F.max_by("last_id", "chunk").alias("latest_id"),
    )


def stack_summaries(ads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per stack_id (canonical form; null is a row of its own): n_rows, n_chars, first and latest date, days with ads, longest gap in days,
    number of chunks, id of the latest ad (date, then id). Null dates sort first and count in n_rows only; null texts count 0 characters.
    An empty table gives no rows; further columns are left out."""
    slim = ads.select(guid(F.col("stack_id")).alias("stack_id"), "date", F.col("id").alias("_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return merge_states(chunk_states(number_rows(slim, "stack_id", ["date", "_id"]), "stack_id", "date", "chars", chunk), "stack_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: stacks that at least 5 % of all ads belong to."""
    ads = table(spark, sf_dir, "ads")
    total = ads.count()  # one number, from the files' footers
    return stack_summaries(ads).filter((F.col("stack_id").isNotNull()) & (F.col("n_rows") * 20 >= total)).select("stack_id")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_stacks: the whole summary with the latest text of each stack."""
    ads = table(spark, sf_dir, "ads")
    s = stack_summaries(ads)
    texts = ads.select(F.col("id").alias("latest_id"), F.col("text").alias("latest_text"))
    return s.join(texts, "latest_id", "left").drop("n_chunks")


__all__ = ["number_rows", "chunk_states", "merge_states", "stack_summaries", "found", "summaries", "CHUNK"]
