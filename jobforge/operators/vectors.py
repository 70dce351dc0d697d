"""The store of signatures: model versions, vectors and buckets, written with their ads as one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions import hashing
from jobforge.operators import merge, minhash
from jobforge.operators.minhash import Model


def model_rows(spark: SparkSession, held: DataFrame | None, model: Model) -> DataFrame:
    """The table of model versions with ``model`` seeded, or active again and with its universe where the version is held; other columns of a held row stay."""
    kind = "version int, hashes int, bands int, seed int, shingle int, universe int, duplicate double, similar double, is_active boolean"
    own = spark.createDataFrame([(model.version, model.hashes, model.bands, model.seed, model.shingle, model.universe, model.duplicate, model.similar, True)], kind)
    if held is None:
        return own
    fresh = own.select(F.col("version").alias("_v"), F.col("universe").alias("_u"))
    kept = held.join(F.broadcast(fresh), F.col("version") == F.col("_v"), "left")  # one row
    kept = kept.withColumn("is_active", F.col("is_active") | F.col("_v").isNotNull()).withColumn("universe", F.coalesce("_u", "universe")).drop("_v", "_u")
    return kept.unionByName(own.join(held.select("version"), "version", "left_anti"))


def vector_rows(ads: DataFrame, model: Model = Model()) -> DataFrame:
    """(ad_id, version, signature, shingles, keys) of ads."""
    return minhash.vectors(ads, model).withColumnRenamed("id", "ad_id").withColumn("version", F.lit(model.version))


def bucket_rows(vectors: DataFrame) -> DataFrame:
    """(ad_id, version, band, key): one row a band."""
    return vectors.select("ad_id", "version", F.posexplode("keys").alias("band", "key"))


def missing(ads: DataFrame, vectors: DataFrame, version: int = 1) -> DataFrame:
    """Unique ads that have no vector of a version."""
    return ads.filter("is_unique").join(vectors.filter(F.col("version") == version).select(F.col("ad_id").alias("id")), "id", "left_anti")


def get(vectors: DataFrame, ads: DataFrame, version: int = 1) -> DataFrame:
    """The vectors of some ads (id) of one version."""
    return vectors.filter(F.col("version") == version).join(ads.select(F.col("id").alias("ad_id")).distinct(), "ad_id", "left_semi")


def add_buckets(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Held buckets and those of new ads; an ad that is held already is an error."""
    twice = incoming.select("ad_id", "version").distinct().join(held.select("ad_id", "version").distinct(), ["ad_id", "version"], "left_semi").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].ad_id} is in the index already")
    return held.unionByName(incoming)


def matches(held: DataFrame, buckets: DataFrame) -> DataFrame:
    """(ad_id, match): other ads that share a bucket with an ad; none for an ad without buckets."""
    b = buckets.select("ad_id", "version", "band", "key")
    return b.join(held.withColumnRenamed("ad_id", "match"), ["version", "band", "key"]).filter("ad_id <> match").select("ad_id", "match").distinct()


def not_duplicates(ads: DataFrame, vectors: DataFrame, held: DataFrame, buckets: DataFrame, least: float) -> DataFrame:
    """Of new ads (id) those that have no match in the index whose signature agrees in ``least`` of its positions or more. An ad isn't its own duplicate.

    Several ads' equal signatures are compared through one of them."""
    own = get(vectors, ads).select("ad_id", "signature", F.posexplode("keys").alias("band", "key"))
    reps = held.groupBy(F.sha2(F.to_json("signature"), 256).alias("h")).agg(F.min("ad_id").alias("match"), F.max("ad_id").alias("_other"), F.first("signature").alias("theirs"), F.first("keys").alias("keys"))
    index = reps.select("match", "_other", "theirs", F.posexplode("keys").alias("band", "key"))
    met = own.join(index, ["band", "key"]).filter((F.col("ad_id") != F.col("match")) | (F.col("ad_id") != F.col("_other")))
    same = met.filter(hashing.agreement(F.col("signature"), F.col("theirs")) >= least).select(F.col("ad_id").alias("id")).distinct()
    return ads.join(same, "id", "left_anti")


def import_ads(spark: SparkSession, path: str, ads: DataFrame, model: Model = Model()) -> int:
    """Take in ads, their vectors and their buckets as one unit; ads that are held already, by id, are left out. Gives the version published."""
    held = merge.published(spark, path)
    new = ads.dropDuplicates(["id"])
    if "ads" in held:
        new = new.join(held["ads"].select("id"), "id", "left_anti")
    v = vector_rows(new, model)
    parts = {"ads": new, "vectors": v, "buckets": bucket_rows(v)}
    return merge.publish(spark, path, {k: held[k].unionByName(df) if k in held else df for k, df in parts.items()})


def backfill(spark: SparkSession, path: str, model: Model = Model()) -> int:
    """Vectors and buckets of the published unique ads that have none of the model's version; gives the version published."""
    held = merge.published(spark, path)
    v = vector_rows(missing(held["ads"], held["vectors"], model.version), model)
    return merge.publish(spark, path, {"vectors": held["vectors"].unionByName(v), "buckets": held["buckets"].unionByName(bucket_rows(v))})


def distinct_unnormalised(ads: DataFrame, model: Model = Model()) -> DataFrame:
    """Ids that the greedy order keeps, newest first, from signatures of the texts as they are, in memory of this run only."""
    v = minhash.vectors(ads, model, normalise=False)
    return minhash.greedy_distinct(minhash.by_date(ads), minhash.buckets(v))
