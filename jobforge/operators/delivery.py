"""At-least-once deliveries: a partitioned store of posts that keeps exactly one copy of each.

The store is a folder: ``posts-X/part=P`` holds single winners, segments of an identifier index map each identifier to the partition that holds it, and
``manifest-N.json``, of which the highest counts, names the live version of every partition and the index's segments. A batch reads and rewrites
only the partitions its identifiers are in; the manifest is renamed into place last, so a reader sees the state before the batch or after it,
never between, and a batch that failed can simply come again. What neither the last two manifests name is removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobforge.functions.session import cut, list_names, new_path, read_text, remove, scratch, table, tidy, write_text
from jobforge.operators.segments import Segments

#: Bots and export tools write a channel's id as -100 followed by it; plain groups as its negative.
CHANNEL_OFFSET = 1_000_000_000_000
KEY = ("telegram_chat_id", "telegram_message_id")


def plain_chat_id(c: Column) -> Column:
    """A chat id as ``chats.telegram_id`` has it: the -100 prefix and the sign are dropped."""
    return F.when(c <= -CHANNEL_OFFSET, -c - CHANNEL_OFFSET).when(c < 0, -c).otherwise(c)


#: Posts a partition is meant to hold: a month with more has several.
PART = 20_000
#: A batch with up to so many identifiers is sent to the index (about 10 MB); a larger one meets it bucket by bucket.
SMALL = 100_000
UNKNOWN = "000000"


class PostStore:
    """Keeps one copy of every post under ``path``.

    The winner of an identifier is the copy delivered last (created_at, then updated_at, telegram_message_date, id, as strings and stamps sort,
    nulls first); ``deliveries`` counts all copies ever taken in. Rows without a chat or message id can't be identified and are left to the
    caller (``unidentified``). Any further columns are kept as they are, whatever they are called, except ``deliveries`` and ``part``, which are
    replaced. An empty batch leaves the store as it was.

    A post's partition is the month of the message, as first seen (000000 where it has no date), and a share of that month by the identifier's hash, so that
    repeated deliveries of one time lie together and a hot chat fills several partitions. It never changes."""

    def __init__(self, spark: SparkSession, path: str, part: int = PART, small: int = SMALL):
        self.spark, self.path, self.part, self.small = spark, path, part, small
        self.segments = Segments(spark, path, "index", {"telegram_chat_id": "bigint", "telegram_message_id": "bigint", "part": "string"}, KEY)

    def _manifest(self, back: int = 0) -> dict:
        """parts: partition -> [folder, posts]; index: segments; epochs: the last batch of each stream."""
        names = sorted((n for n in list_names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")), key=lambda n: int(n[9:-5]))
        if len(names) <= back:
            return {"version": 0, "parts": {}, "index": [], "epochs": {}}
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1 - back]}"))

    def posts(self, parts: list[str] | None = None) -> DataFrame | None:
        """The live winners, of all partitions or some; None where there is nothing yet."""
        m = self._manifest()
        by_folder: dict[str, list[str]] = {}
        for p, (folder, _) in m["parts"].items():
            if parts is None or p in parts:
                by_folder.setdefault(folder, []).append(f"{self.path}/{folder}/part={p}")
        out = None
        for folder, paths in sorted(by_folder.items()):
            df = self.spark.read.schema(m["schema"]).option("basePath", f"{self.path}/{folder}").parquet(*paths)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def index(self) -> DataFrame | None:
        """(chat, message, part) of every identifier ever taken in."""
        m = self._manifest()
        return self.segments.scan(m["index"]) if m["index"] else None

    @staticmethod
    def unidentified(df: DataFrame) -> DataFrame:
        """The rows that no identifier holds together: each is its own post."""
        return df.filter(F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull())

    def upsert(self, batch: DataFrame, stream: str | None = None, epoch: int = 0) -> dict:
        """Take in a batch; gives the number of partitions rewritten and of those kept. A ``stream``'s batch that was taken in already, by its epoch, changes nothing."""
        m = self._manifest()
        if stream is not None and m["epochs"].get(stream, -1) >= epoch:
            return {"rewritten": 0, "kept": len(m["parts"])}
        with scratch(self.spark):
            return self._upsert(m, batch, {**m["epochs"], stream: epoch} if stream is not None else m["epochs"])

    def _located(self, m: dict, own: DataFrame) -> DataFrame:
        """(chat, message, part, is_new) of the batch's identifiers."""
        keys = cut(own.groupBy(*KEY).agg(F.coalesce(F.date_format(F.min("telegram_message_date"), "yyyyMM"), F.lit(UNKNOWN)).alias("month")), "post-keys")
        if not m["index"]:
            found = keys.withColumn("held", F.lit(None).cast("string"))
        elif keys.count() <= self.small:
            known = self.segments.scan(m["index"]).join(F.broadcast(keys.select(*KEY)), list(KEY), "left_semi")
            found = keys.join(known.withColumnRenamed("part", "held"), list(KEY), "left")
        else:
            found = keys
            for i, s in enumerate(m["index"]):
                found = found.join(self.segments.table(s).withColumnRenamed("part", f"_{i}"), list(KEY), "left")
            held = [f"_{i}" for i in range(len(m["index"]))]
            found = found.withColumn("held", F.coalesce(*held)).drop(*held)
        found = cut(found, "post-found")
        shares = found.filter("held IS NULL").groupBy("month").agg(F.ceil(F.count(F.lit(1)) / self.part).alias("shares"))  # a row a month
        share = F.pmod(F.xxhash64(*KEY), F.coalesce("shares", F.lit(1)))
        fresh = F.concat("month", F.lit("-"), share.cast("string"))
        return cut(found.join(F.broadcast(shares), "month", "left").select(*KEY, F.coalesce("held", fresh).alias("part"), F.col("held").isNull().alias("is_new")), "post-lookup")

    def _upsert(self, m: dict, batch: DataFrame, epochs: dict) -> dict:
        spark = self.spark
        own = batch.drop("deliveries", "part").withColumn(KEY[0], plain_chat_id(F.col(KEY[0]).cast("long"))).filter(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
        located = self._located(m, own)
        touched = {r.part: r.n for r in located.groupBy("part").agg(F.sum(F.col("is_new").cast("long")).alias("n")).collect()}  # a row a partition, not a post
        if not touched:
            return {"rewritten": 0, "kept": len(m["parts"])}
        places = located.select(*KEY, "part")
        incoming = own.withColumn("deliveries", F.lit(1).cast("long")).join(F.broadcast(places) if places.count() <= self.small else places, list(KEY))
        held = self.posts(sorted(set(touched) & set(m["parts"])))
        rows = incoming if held is None else incoming.unionByName(held.withColumn("part", F.col("part").cast("string")), allowMissingColumns=True)
        order = [F.col(c).desc_nulls_last() for c in ("created_at", "updated_at", "telegram_message_date", "id") if c in rows.columns]
        same = Window.partitionBy("part", *KEY)
        # one shuffle, by partition: a partition is one task's work and one file
        winners = (
            rows.repartition(F.col("part"))
            .withColumn("_n", F.row_number().over(same.orderBy(*order)))
            .withColumn("deliveries", F.sum("deliveries").over(same))
            .filter("_n = 1")
            .drop("_n")
        )
        at = f"posts-{uuid.uuid4().hex[:12]}"
        with tidy(spark):
            winners.write.partitionBy("part").parquet(f"{self.path}/{at}")
        index, gone, n_new = m["index"], [], sum(touched.values())
        if n_new:
            index, gone = self.segments.merged([*index, self.segments.write(located.filter("is_new"), n_new)])
        parts = {**m["parts"], **{p: [at, m["parts"].get(p, [None, 0])[1] + n] for p, n in touched.items()}}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in winners.schema)
        after = {"version": m["version"] + 1, "parts": parts, "index": index, "epochs": epochs, "schema": schema}
        before = self._manifest(1)
        write_text(spark, f"{self.path}/manifest-{after['version']}.json", json.dumps(after))
        for s in gone:
            self.segments.forget(s, files=False)
        self._clean(before, m, after)
        return {"rewritten": len(touched), "kept": len(parts) - len(touched)}

    def _clean(self, before: dict, m: dict, after: dict) -> None:
        """Remove what the manifest before the last one names and neither of the two later ones does; readers of the last state aren't disturbed."""
        alive = {(p, f) for x in (m, after) for p, (f, _) in x["parts"].items()}
        folders = {f for _, f in alive}
        for p, (f, _) in before["parts"].items():
            if f not in folders:
                remove(self.spark, f"{self.path}/{f}")
            elif (p, f) not in alive:
                remove(self.spark, f"{self.path}/{f}/part={p}")
        for s in before["index"]:
            if s not in m["index"] and s not in after["index"]:
                remove(self.spark, f"{self.path}/{s[0]}")
        if before["version"]:
            remove(self.spark, f"{self.path}/manifest-{before['version']}.json")


def load_store(spark: SparkSession, messages: DataFrame, path: str | None = None, together: int = 6) -> PostStore:
    """Bring a whole table into a store: the first import run, which is the history, and then ``together`` later runs at a time. Rows without a run
    belong to the first."""
    store = PostStore(spark, path or new_path(spark, "posts"))
    stamp = F.col("created_at")
    runs = sorted(r[0] for r in messages.filter(stamp.isNotNull()).select("created_at").distinct().collect())  # stamps of runs, not of rows
    store.upsert(messages.filter(stamp.isNull() | (stamp == F.lit(runs[0]))) if runs else messages)
    for a in range(1, len(runs), together):
        own = runs[a : a + together]
        store.upsert(messages.filter(stamp.between(F.lit(own[0]), F.lit(own[-1]))))
    return store


def _delivered(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(chat, message, deliveries) of every post of a table; no rows where it has none."""
    posts = load_store(spark, messages).posts()
    if posts is None:
        kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in KEY[1:])
        posts = spark.createDataFrame([], f"{KEY[0]} bigint, {kinds}, deliveries bigint")
    return posts.select(*KEY, "deliveries")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: the posts delivered more than once."""
    posts = _delivered(spark, table(spark, sf_dir, "messages"))
    return posts.filter("deliveries > 1").select(*KEY)


def per_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_chats: per chat the posts, their deliveries and the rows that can't be identified."""
    m = table(spark, sf_dir, "messages")
    posts = _delivered(spark, m).select("telegram_chat_id", F.lit(1).alias("posts"), "deliveries", F.lit(0).alias("unidentified"))
    rest = PostStore.unidentified(m).select(plain_chat_id(F.col("telegram_chat_id")).alias("telegram_chat_id"), F.lit(0).alias("posts"), F.lit(0).cast("long").alias("deliveries"), F.lit(1).alias("unidentified"))
    return posts.unionByName(rest).groupBy("telegram_chat_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("posts", "deliveries", "unidentified")))
