"""Readers and writers of the file formats around the tables."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import list_names, read_text

CHAT = "id long, name string, messages array<struct<id:long,date:timestamp,text_entities:array<struct<type:string,text:string>>>>"
#: Known kinds of text entries and codes of currencies in the rates' XML.
ENTRY_TYPES = ["bold", "code", "custom_emoji", "email", "hashtag", "italic", "link", "mention", "plain", "text_link", "underline"]
XML_CODES = {"R01235": "USD", "R01239": "EUR"}


def read_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chat exports (*.json, one document a file): one row a chat."""
    return spark.read.schema(CHAT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def chat_messages(chats: DataFrame) -> DataFrame:
    """(chat id, name, message id, date, entries): one row a message; kinds of entries that aren't known become "other"."""
    kind = lambda e: F.when(e["type"].isin(*ENTRY_TYPES), e["type"]).otherwise(F.lit("other"))
    m = chats.select(F.col("id").alias("telegram_chat_id"), "name", F.explode("messages").alias("m"))
    entries = F.transform("m.text_entities", lambda e: F.struct(kind(e).alias("type"), e["text"].alias("text")))
    return m.select("telegram_chat_id", "name", F.col("m.id").alias("telegram_message_id"), F.col("m.date").alias("telegram_message_date"), entries.alias("text_entries"))


def read_rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """base, target, date, value; lines of another shape are skipped; the last line of a (target, date) counts."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f"), F.monotonically_increasing_id().alias("n")).filter("size(f) = 4")
    rows = lines.select(F.trim(F.col("f")[0]).alias("base"), F.trim(F.col("f")[1]).alias("target"), F.trim(F.col("f")[2]).try_cast("date").alias("date"), F.trim(F.col("f")[3]).try_cast("double").alias("value"), "n")
    return rows.filter("date IS NOT NULL AND value IS NOT NULL").groupBy("target", "date").agg(F.max_by("base", "n").alias("base"), F.max_by("value", "n").alias("value")).select("base", "target", "date", "value")


def append_rates_csv(held: DataFrame, incoming: DataFrame, path: str) -> None:
    """Write what (target, date) doesn't hold yet; of incoming rows of one key the first in the table's own order counts."""
    numbered = incoming.withColumn("_n", F.monotonically_increasing_id())
    first = numbered.groupBy("target", "date").agg(F.min_by("base", "_n").alias("base"), F.min_by("value", "_n").alias("value"))
    new = first.join(held.select("target", "date").distinct(), ["target", "date"], "left_anti")
    new.select("base", "target", "date", "value").write.mode("append").csv(path)


def read_rates_xml(spark: SparkSession, path: str, base: str = "RUB") -> DataFrame:
    """Records of a bank's XML: each gives the rate and its inverse, rounded to four digits half to even; decimal commas are read."""
    schema = "_Date string, _Id string, Nominal string, Value string"
    x = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    code = F.create_map(*(F.lit(v) for kv in XML_CODES.items() for v in kv))
    v = F.regexp_replace("Value", ",", ".").cast("double")
    r = x.select(code[F.col("_Id")].alias("cur"), F.to_date("_Date", "dd.MM.yyyy").alias("date"), v.alias("v")).filter("cur IS NOT NULL AND v > 0")
    both = F.array(F.struct(F.lit(base).alias("base"), F.col("cur").alias("target"), "date", F.col("v").alias("value")), F.struct(F.col("cur").alias("base"), F.lit(base).alias("target"), "date", F.bround(1 / F.col("v"), 4).alias("value")))
    return r.select(F.inline(both))


def currency_code(currency: str) -> str:
    """The bank's code of a currency; one without a code is an error."""
    for code, name in XML_CODES.items():
        if name == currency:
            return code
    raise ValueError(f"no code for the currency {currency!r}")


def refresh_rates(spark: SparkSession, path: str, fetch, today: dt.date, first: dt.date, base: str = "RUB") -> DataFrame:
    """Rates of a CSV folder, brought up to ``today``: for every currency but the base ``fetch(base, target, from_date)`` gives rows (base, target, date,
    value) from the last stored date on (from ``first`` where nothing is stored, or where what is stored begins later), which are appended where (target,
    date) isn't held. Nothing is fetched where the stored rates reach today. ``fetch`` is the plug-in that may call an outside service."""
    kind = "base string, target string, date date, value double"
    there = any(n.endswith(".csv") for n in list_names(spark, path))
    held = read_rates_csv(spark, path) if there else spark.createDataFrame([], kind)
    low, high = held.agg(F.min("date"), F.max("date")).first()
    since = first if high is None else min(high, today)
    if low is not None and low > first:
        since = first
    if since < today or high is None:
        rows = [r for t in sorted(XML_CODES.values()) if t != base for r in fetch(base, t, since)]
        if rows:  # days of a few currencies
            append_rates_csv(held, spark.createDataFrame(rows, kind), path)
            return read_rates_csv(spark, path)
    return held


def entries_json(entries: Column) -> Column:
    """Text entries as they are kept in a text column: a JSON list of {Type, Value}; [] for an empty list and for null."""
    text = F.to_json(F.transform(entries, lambda e: F.struct(e["type"].alias("Type"), e["text"].alias("Value"))))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, F.lit("[]")).otherwise(text)


def entries_from_json(text: Column) -> Column:
    """Text entries from such a JSON list; an empty list for null, empty text and []."""
    got = F.from_json(text, "array<struct<Type:string,Value:string>>")
    return F.coalesce(F.transform(got, lambda e: F.struct(e["Type"].alias("type"), e["Value"].alias("text"))), F.array().cast("array<struct<type:string,text:string>>"))


def read_stack_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(chat_id, channel, stack) of a mapping file; a missing file is an error."""
    schema = "channels array<struct<chatId:long,channel:string,stack:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("channels").alias("c")).select(F.col("c.chatId").alias("chat_id"), F.col("c.channel").alias("channel"), F.col("c.stack").alias("stack"))


def finite_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; numbers that aren't finite are null, and null members are left out."""
    cols = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def locale_files(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """Locale texts of a folder of LOCALE.json files."""
    return read_locales({n[:-5]: read_text(spark, f"{folder}/{n}") for n in list_names(spark, folder) if n.endswith(".json")})


def read_locales(texts: dict[str, str]) -> dict[str, dict[str, str]]:
    """Flat maps of locale texts by locale; dotted keys stay flat."""
    return {k: {str(a): str(b) for a, b in json.loads(v).items()} for k, v in texts.items()}


def nested(flat: dict[str, str], prefix: str = "ui.") -> dict:
    """Dotted keys below a prefix as a nested map."""
    out: dict = {}
    for k, v in flat.items():
        if k.startswith(prefix):
            at = out
            *path, leaf = k[len(prefix) :].split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[leaf] = v
    return out
