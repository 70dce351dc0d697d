"""Incremental import as a stream: new chat exports are merged into the store of posts, each batch whole and once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.operators.delivery import PostStore
from jobforge.sources.files import CHAT, chat_messages


def import_stream(spark: SparkSession, folder: str, store_path: str, checkpoint: str):
    """Read new files of a folder once each and upsert their messages; returns the started query (available-now trigger)."""
    store = PostStore(spark, store_path)
    chats = spark.readStream.schema(CHAT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)

    def merge(batch: DataFrame, epoch: int) -> None:
        m = chat_messages(batch)
        now = F.current_timestamp()
        store.upsert(m.withColumn("id", F.concat_ws("-", "telegram_chat_id", "telegram_message_id")).withColumn("created_at", now).withColumn("updated_at", now), stream=checkpoint, epoch=epoch)

    return chats.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_stream(spark: SparkSession, folder: str, delay: str = "1 day", width: str = "30 days"):
    """Messages per chat and window of event time, late ones up to ``delay``; an unstarted streaming frame."""
    chats = spark.readStream.schema(CHAT).option("multiLine", True).json(folder)
    return chat_messages(chats).withWatermark("telegram_message_date", delay).groupBy(F.window("telegram_message_date", width), "telegram_chat_id").agg(F.count(F.lit(1)).alias("n"))
