"""Extraction of pay, level and place from ads by plug-ins, and the answers such plug-ins give.

A plug-in is a function of one text that gives a JSON text with short keys: p, lb, ub, prd, cur (pay), loc, fmt (place) and pl (level). Without one, column
expressions read pay and place, and no Python runs. Plug-ins are called in Arrow batches, behind an adaptive limit a worker.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.functions import limits
from jobforge.functions.session import cut
from jobforge.operators.levels import resolve_level
from jobforge.operators.salary import parse_text

ANSWER = "p boolean, lb double, ub double, prd string, cur string, loc string, fmt string, pl string"
#: Members of the enumerations in an answer, by number.
CURRENCIES = ["unknown", "usd", "eur", "rub"]
PERIODS = ["unknown", "day", "month", "project"]
LEVELS = ["unknown", "intern", "junior", "middle", "senior", "lead", "architect", "manager"]
LOCATIONS = ["unknown", "russia", "belarus", "cis", "europe", "us", "middleEast", "other"]
FORMATS = ["unknown", "onSite", "hybrid", "remoteDomestic", "remoteWorldwide"]


def member(c: Column, labels: list[str]) -> Column:
    """The number of an enumeration's member given by name (case aside) or by number; null where it is neither."""
    number = c.try_cast("int")
    by_name = F.coalesce(*(F.when(F.lower(c) == label.lower(), F.lit(i)) for i, label in enumerate(labels)))
    return F.coalesce(by_name, F.when((number >= 0) & (number < len(labels)), number))


def parsed(answer: Column) -> Column:
    """A struct (present, lower, upper, period, currency, location, work_format, level) of an answer; all null where it is no JSON object. Bounds are
    given whatever ``p`` says."""
    a = F.from_json(answer, ANSWER)
    return F.struct(
        a["p"].alias("present"), a["lb"].alias("lower"), a["ub"].alias("upper"), member(a["prd"], PERIODS).alias("period"), member(a["cur"], CURRENCIES).alias("currency"),
        member(a["loc"], LOCATIONS).alias("location"), member(a["fmt"], FORMATS).alias("work_format"), member(a["pl"], LEVELS).alias("level"),
    )


def answers(ads: DataFrame, plug_in: Callable[[str], str], retries: int = 3) -> DataFrame:
    """(id, answer): what a plug-in says about each text that isn't blank. A rate limit is waited out and tried again, a spent quota ends the calls of
    that task, any other error leaves the ad without an answer; such ads come up again with the next run."""

    def run(batches):
        limit, spent = limits.AdaptiveLimit(), threading.Event()

        def ask(text: str) -> str | None:
            for _ in range(retries):
                if spent.is_set():
                    return None
                try:
                    with limit:
                        return plug_in(text)
                except Exception as e:  # noqa: BLE001 - whatever an outside service raises
                    if limits.is_quota(str(e)):
                        spent.set()
                    if not limits.is_rate_limit(str(e)):
                        return None
            return None

        with ThreadPoolExecutor(limit.most) as pool:
            for pdf in batches:
                yield pdf[["id"]].assign(answer=list(pool.map(ask, pdf["text"])))

    todo = ads.filter(F.length(F.trim("text")) > 0).select("id", "text")
    return todo.mapInPandas(run, "id string, answer string").filter("answer IS NOT NULL")


def first_amount(text: Column) -> Column:
    """The line that names an amount with a currency's sign or name, for ``parse_text``; null where none does."""
    line = F.regexp_extract(text, r"(?iu)([^\n]*\d[^\n]*(?:[$€₽]|руб|usd|eur|доллар|евро)[^\n]*|[^\n]*[$€₽]\s?\d[^\n]*)", 1)
    steps = [("(?iu)руб[а-я]*\\.?", "₽"), ("(?iu)usd|доллар[а-я]*", r"\$"), ("(?iu)eur|евро", "€"), (r"(?<=\d)[ \u00A0](?=\d{3}(?!\d))", ""), (r"(?iu)(?<=\d)\s?(?:к|k|тыс\.?)(?![а-яa-z])", "k")]
    for pattern, put in steps:
        line = F.regexp_replace(line, pattern, put)
    word, to = "(?:от|до|from|to)?", r"(?:[-–—]|до|to)"
    amount = rf"(?iu)({word}\s*(?:[$€₽]\s?\d+k?(?:\s*{to}\s*[$€₽]?\s?\d+k?)?|\d+k?(?:\s*{to}\s*\d+k?)?\s?[$€₽]))"
    found = F.regexp_extract(line, amount, 1)
    return F.when(F.length(found) > 0, found)


def by_rules(ads: DataFrame, place: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """(id, parsed) by column expressions: the first amount of the text, month as the period where there is one, and the place by ``place``."""
    cur, lower, upper = parse_text(F.coalesce(first_amount(F.col("text")), F.lit("")))
    there = ~F.isnan(lower) | ~F.isnan(upper)
    location, work_format = place(F.col("text"))
    found = F.struct(
        there.alias("present"), F.when(~F.isnan(lower), lower).alias("lower"), F.when(~F.isnan(upper), upper).alias("upper"), F.when(there, F.lit(2)).alias("period"),
        F.when(there, cur).alias("currency"), location.alias("location"), work_format.alias("work_format"), F.lit(None).cast("int").alias("level"),
    )
    return ads.filter(F.length(F.trim("text")) > 0).select("id", found.alias("parsed"))


def extract(ads: DataFrame, salaries: DataFrame, messages: DataFrame, place: Callable, plug_in: Callable[[str], str] | None = None) -> dict[str, DataFrame]:
    """Of ads that have no salary row yet: ``salaries`` (ad_id, date, currency, lower_bound, upper_bound, period, level; status 1) where a bound or a
    currency was found, and ``places`` (id, location, work_format) of all of them, pay or not. The level is that of the message's tags, else the
    answer's. Ads without an answer come up again."""
    todo = ads.select(F.col("id").cast("string").alias("id"), "date", "message_id", "text").dropDuplicates(["id"]).join(salaries.select(F.col("ad_id").alias("id")).distinct(), "id", "left_anti")
    if plug_in is None:
        got = by_rules(todo, place)
    else:
        got = answers(todo, plug_in).select("id", parsed(F.col("answer")).alias("parsed"))
    got = cut(got, "extracted")  # a plug-in's calls are made once
    tags = messages.groupBy(F.col("id").alias("message_id")).agg(F.max(resolve_level(F.col("tags"))).alias("tagged"))
    j = got.join(todo.select("id", "date", "message_id"), "id").join(tags, "message_id", "left")
    level = F.when(F.col("tagged") > 0, F.col("tagged")).otherwise(F.coalesce("parsed.level", F.lit(0)))
    paid = j.filter(F.coalesce("parsed.lower", "parsed.upper").isNotNull())
    return {
        "salaries": paid.select(F.col("id").alias("ad_id"), "date", F.coalesce("parsed.currency", F.lit(0)).alias("currency"), F.col("parsed.lower").alias("lower_bound"), F.col("parsed.upper").alias("upper_bound"), F.coalesce("parsed.period", F.lit(0)).alias("period"), F.lit(1).alias("status"), level.alias("level")),
        "places": got.select("id", F.coalesce("parsed.location", F.lit(0)).alias("location"), F.coalesce("parsed.work_format", F.lit(0)).alias("work_format")),
    }


def chunked(df: DataFrame, size: int, order: str) -> DataFrame:
    """Add ``chunk``, from 0: rows in order, ``size`` to a chunk, the last one with what is left. Rows are numbered over range partitions, without one task
    that holds them all."""
    from jobforge.operators.hotkeys import number_rows

    n = number_rows(df.withColumn("_all", F.lit(0)), "_all", [order])
    return n.withColumn("chunk", F.floor((F.col("row_no") - 1) / size)).drop("_all", "row_no")
