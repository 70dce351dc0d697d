"""Mutations as functions of tables: inserts without doubles, upserts, updates by key, identifier migration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.hashing import name_guid
from jobforge.functions.session import list_names, read_text, write_text
from jobforge.functions.text import stack_name


def insert_new(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Held rows and the incoming ones whose key isn't held yet, one row a key: of incoming rows of one key any one."""
    return held.unionByName(incoming.dropDuplicates(key).join(held.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def cleared(df: DataFrame) -> DataFrame:
    """A bulk delete: the table without any of its rows, those outside a filtered view included."""
    return df.limit(0)


def update_places(ads: DataFrame, found: DataFrame) -> DataFrame:
    """Location and work format from ``found`` (id, location, work_format; of several rows of an id the largest); where both are unknown nothing is written."""
    new = found.filter((F.col("location") != 0) | (F.col("work_format") != 0)).groupBy("id").agg(F.max(F.struct("location", "work_format")).alias("_p"))
    j = ads.join(new, "id", "left")
    return j.withColumns({c: F.coalesce(F.col("_p")[c], F.col(c)).cast(ads.schema[c].dataType) for c in ("location", "work_format")}).select(*ads.columns)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write several tables as one unit: all of them to fresh folders, then a manifest renamed into place that names them; gives its version. A
    reader sees all tables of one version, and after a failure the version before."""
    v = _version(spark, path) + 1
    named = {}
    for name, df in tables.items():
        named[name] = f"{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{path}/{named[name]}")
    held = json.loads(read_text(spark, f"{path}/unit-{v - 1}.json")) if v > 1 else {}
    write_text(spark, f"{path}/unit-{v}.json", json.dumps({**held, **named}))
    return v


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last version; none where nothing was published."""
    v = _version(spark, path)
    return {name: spark.read.parquet(f"{path}/{at}") for name, at in json.loads(read_text(spark, f"{path}/unit-{v}.json")).items()} if v else {}


def _version(spark: SparkSession, path: str) -> int:
    return max((int(n[5:-5]) for n in list_names(spark, path) if n.startswith("unit-") and n.endswith(".json")), default=0)


def upsert(held: DataFrame, incoming: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """A full outer merge: columns in ``update`` come from the incoming row where there is one, others from the held row where there is one."""
    a, b = held.alias("a"), incoming.alias("b")
    j = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    there = F.col(f"b.{key[0]}").isNotNull()
    out = []
    for c in held.columns:
        if c in update:
            out.append(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
    return j.select(*out)


def update_where(df: DataFrame, changes: DataFrame, key: str, columns: list[str], only: Column | None = None) -> DataFrame:
    """Set columns from ``changes`` (one row a key) where the row has one, its value isn't null, and ``only`` holds."""
    c = changes.select(key, *(F.col(x).alias(f"_new_{x}") for x in columns))
    cond = F.lit(True) if only is None else only
    j = df.join(c, key, "left")
    return j.select(*(F.when(cond & F.col(f"_new_{x}").isNotNull(), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in df.columns))


def migrate_ids(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace identifiers by ``mapping`` (old, new); an id whose new form is in use already, or that isn't mapped, stays."""
    used = df.select(F.col(column).alias("new")).distinct()
    free = mapping.join(used, "new", "left_anti").select(F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(free, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def migrate_all(tables: dict[str, DataFrame], messages_space: str, ads_space: str) -> dict[str, DataFrame]:
    """Identifiers of messages and ads made anew from (chat, message): messages.id, ads.message_id, ads.id, and ad_id of salaries, vectors and buckets,
    of those tables that are given. An ad whose new id is in use stays as it is, dependents too; of several ads with one new id the smallest
    old id takes it. Messages without a number keep their ids. The result is meant for ``publish``, all or nothing."""
    m = tables["messages"].filter("telegram_chat_id IS NOT NULL AND telegram_message_id IS NOT NULL")
    place = F.concat_ws(":", F.col("telegram_chat_id").cast("string"), F.col("telegram_message_id").cast("string"))
    messages = m.groupBy("id").agg(F.min(place).alias("place"))
    new_message = messages.select("id", name_guid(messages_space, F.col("place")).alias("_new"))
    wanted = tables["ads"].select("id", "message_id").join(messages.withColumnRenamed("id", "message_id"), "message_id").select("id", name_guid(ads_space, F.concat("place", F.lit(":ad"))).alias("_new"))
    first = wanted.filter("id <> _new").groupBy("_new").agg(F.min("id").alias("id"))
    new_ad = first.join(tables["ads"].select(F.col("id").alias("_new")), "_new", "left_anti").select("id", "_new")

    def moved(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        j = df.join(ids.withColumnRenamed("id", column), column, "left")
        return j.withColumn(column, F.coalesce("_new", column)).select(*df.columns)

    out = dict(tables)
    out["messages"] = moved(tables["messages"], "id", new_message)
    out["ads"] = moved(moved(tables["ads"], "message_id", new_message), "id", new_ad)
    for name in ("salaries", "vectors", "buckets"):
        if name in tables:
            out[name] = moved(tables[name], "ad_id", new_ad)
    return out


def missing_names(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Normalised names in ``wanted`` that ``held`` lacks, case and composition aside."""
    norm = stack_name(F.col("name"))
    return wanted.select(norm.alias("name")).distinct().join(held.select(norm.alias("name")).distinct(), "name", "left_anti").filter("name <> ''")
