"""Distinct ads by minwise signatures and banded buckets, with the exact greedy order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobforge.functions import hashing
from jobforge.functions.session import cut, drop_cut, keep, scratch, table
from jobforge.functions.text import normalize_ad


@dataclass(frozen=True)
class Model:
    """Parameters of signatures; bands must divide the number of hashes, and a version below 1 counts as 1."""

    hashes: int = 100
    bands: int = 20
    seed: int = 1000
    shingle: int = 5
    universe: int = 1_000_000
    version: int = 1
    duplicate: float = 0.92
    similar: float = 0.80

    def __post_init__(self):
        if self.hashes % self.bands:
            raise ValueError("bands must divide hashes")
        object.__setattr__(self, "version", max(self.version, 1))

    @property
    def rows(self) -> int:
        return self.hashes // self.bands


def vectors(df: DataFrame, model: Model = Model(), id_col: str = "id", text_col: str = "text", normalise: bool = True) -> DataFrame:
    """(id, signature, shingles, keys): signature of the text, normalised or as it is, its number of distinct shingles, and a key per band.

    Null texts have no vector; a text shorter than a shingle has an all-ones signature."""
    masks, bits = hashing.family(model.hashes, model.universe, model.seed)

    def run(batches):
        for b in batches:
            sigs, counts, keys = [], [], []
            for t in b.column("text").to_pylist():
                h = hashing.shingle_hashes(t, model.shingle)
                s = hashing.signature(h, masks, bits)
                sigs.append(s.astype(np.int64))
                counts.append(len({t[i : i + model.shingle] for i in range(len(t) - model.shingle + 1)}))
                keys.append(hashing.band_keys(s, model.bands))
            offsets = pa.array(np.arange(len(sigs) + 1) * model.hashes, pa.int32())
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, flat), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.string()))], ["id", "signature", "shingles", "keys"])

    own = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), (normalize_ad(F.col(text_col)) if normalise else F.col(text_col)).alias("text"))
    return own.mapInArrow(run, "id string, signature array<long>, shingles int, keys array<string>")


def buckets(v: DataFrame) -> DataFrame:
    """(id, band, key): one row for each band of each vector."""
    return v.select("id", F.posexplode("keys").alias("band", "key"))


def greedy_distinct(order: DataFrame, in_buckets: DataFrame) -> DataFrame:
    """Ids kept when rows are taken in order (``id``, ``rank`` struct) and one is dropped as soon as it shares a bucket with a kept one.

    Rounds of: drop whoever shares a bucket with a kept row; keep whoever is first among the undecided in all its buckets. Buckets are never
    expanded into pairs, so one that holds a third of all rows costs as much as its rows. Rows without buckets are kept."""
    with scratch(order.sparkSession):
        return keep(cut(_rounds(order, in_buckets), "distinct"))


def _rounds(order: DataFrame, in_buckets: DataFrame) -> DataFrame:
    state = cut(in_buckets.join(order, "id").select("id", "rank", "band", "key"), "lsh")
    kept = None
    while True:
        firsts = state.groupBy("band", "key").agg(F.min(F.struct("rank", "id")).alias("first"))
        lead = state.join(firsts, ["band", "key"]).groupBy("id").agg(F.min((F.col("first.id") == F.col("id")).cast("int")).alias("leads"))
        new = cut(lead.filter("leads = 1").select("id"), "kept")
        if not new.limit(1).count():
            break
        kept = new if kept is None else kept.unionByName(new)
        hit = state.join(new, "id", "left_semi").select("band", "key").distinct()
        gone = state.join(hit, ["band", "key"], "left_semi").select("id").distinct()
        before, state = state, cut(state.join(gone, "id", "left_anti"), "lsh")
        drop_cut(before)
    loose = order.join(in_buckets.select("id").distinct(), "id", "left_anti").select("id")
    return loose if kept is None else loose.unionByName(kept)


def by_date(df: DataFrame) -> DataFrame:
    """(id, rank): newest first, ties by id."""
    return df.select(F.col("id").cast("string").alias("id"), F.struct((-F.unix_date("date")).alias("d"), F.col("id").cast("string").alias("i")).alias("rank"))


def candidates(in_buckets: DataFrame) -> DataFrame:
    """(a, b): ids that share a bucket, a < b. Meant for vectors of different texts."""
    x, y = in_buckets.alias("x"), in_buckets.alias("y")
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_pairs(v: DataFrame, least: float) -> DataFrame:
    """Candidate pairs whose signatures agree in ``least`` or more of their positions. Equal signatures are compared once, through their smallest id."""
    reps = v.groupBy(F.sha2(F.to_json("signature"), 256).alias("h")).agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    pairs = candidates(buckets(reps))
    sig = reps.select("id", "signature")
    j = pairs.join(sig.withColumnRenamed("id", "a").withColumnRenamed("signature", "sa"), "a").join(sig.withColumnRenamed("id", "b").withColumnRenamed("signature", "sb"), "b")
    return j.withColumn("agreement", hashing.agreement(F.col("sa"), F.col("sb"))).filter(F.col("agreement") >= least).select("a", "b", "agreement")


def distinct_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ded2_distinct: ids of ads that the greedy order keeps, newest first."""
    a = table(spark, sf_dir, "ads")
    v = cut(vectors(a), "vectors")
    return greedy_distinct(by_date(a), buckets(v))


def mark_unique(ads: DataFrame, kept: DataFrame) -> DataFrame:
    """is_unique only ever turns true."""
    k = kept.select("id").withColumn("_kept", F.lit(True))
    return ads.join(k, "id", "left").withColumn("is_unique", F.coalesce(F.col("is_unique"), F.lit(False)) | F.coalesce("_kept", F.lit(False))).drop("_kept")


def upsert_vectors(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (id, version): the incoming payload replaces the held one, created_at of the held row stays."""
    h = held.select("id", "version", F.col("created_at").alias("_held"))
    new = incoming.join(h, ["id", "version"], "left").withColumn("created_at", F.coalesce("_held", "created_at")).drop("_held")
    return held.join(incoming.select("id", "version"), ["id", "version"], "left_anti").unionByName(new)


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
