"""Technology stacks of ads by their chat: a mapping of chats to stack names, resolved in two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobforge.functions.session import guid
from jobforge.functions.text import stack_name
from jobforge.operators.delivery import plain_chat_id


def chat_stacks(mapping: DataFrame, stacks: DataFrame) -> DataFrame:
    """(chat, stack_id) from a mapping (chat_id, channel, stack) and the stacks (id, name), names compared case, composition and blanks aside; rows whose
    stack isn't known fall out, and of several stacks of a chat the smallest id counts. One row a chat of the mapping."""
    m = mapping.select(plain_chat_id(F.col("chat_id")).alias("chat"), stack_name(F.col("stack")).alias("_n"))
    s = stacks.select(F.col("id").alias("stack_id"), stack_name(F.col("name")).alias("_n"))
    return m.join(s, "_n").groupBy("chat").agg(F.min("stack_id").alias("stack_id"))


def ad_chats(ads: DataFrame, messages: DataFrame) -> DataFrame:
    """The ads with the chat of their message (null where there is no such message)."""
    chat = messages.groupBy(F.col("id").alias("message_id")).agg(F.min(plain_chat_id(F.col("telegram_chat_id"))).alias("chat"))
    return ads.join(chat, "message_id", "left")


def resolved(ads: DataFrame, messages: DataFrame, mapping: DataFrame, stacks: DataFrame) -> DataFrame:
    """New ads with the stack that their chat maps to; ads whose chat isn't resolved are dropped."""
    by_chat = chat_stacks(mapping, stacks)
    return ad_chats(ads.drop("stack_id"), messages).join(by_chat, "chat").drop("chat")


def backfilled(ads: DataFrame, messages: DataFrame, chats: DataFrame, mapping: DataFrame, stacks: DataFrame) -> DataFrame:
    """Ads without a stack take the one their chat maps to, where the chat is known and the ad is in the view of unique ones; other ads stay."""
    by_chat = chat_stacks(mapping, stacks).withColumnRenamed("stack_id", "_new").join(chats.select(F.col("telegram_id").alias("chat")).distinct(), "chat", "left_semi")
    j = ad_chats(ads, messages).join(by_chat, "chat", "left")
    return j.withColumn("stack_id", F.when(F.col("stack_id").isNull() & F.col("is_unique"), F.col("_new")).otherwise(F.col("stack_id"))).select(*ads.columns)


def assigned(ads: DataFrame, messages: DataFrame, chats: DataFrame, stacks: DataFrame, name: str) -> DataFrame:
    """All ads without a stack whose message is in one of the chats take one stack, whether they are unique or not; a stack that doesn't exist is an error."""
    held = stacks.filter(stack_name(F.col("name")) == stack_name(F.lit(name))).select("id").limit(1).collect()  # one row
    if not held:
        raise ValueError(f"no technology stack {name!r}")
    known = chats.select(F.col("telegram_id").alias("chat"), F.lit(True).alias("_known")).distinct()
    j = ad_chats(ads, messages).join(known, "chat", "left")
    return j.withColumn("stack_id", F.when(F.col("stack_id").isNull() & F.col("_known"), F.lit(held[0].id)).otherwise(F.col("stack_id"))).select(*ads.columns)


def with_guids(ads: DataFrame) -> DataFrame:
    """Ads with the stack's id in canonical form."""
    return ads.withColumn("stack_id", guid(F.col("stack_id")))
