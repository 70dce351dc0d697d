"""Named steps over tables: a registry, and the plug-ins a step may call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.operators import extraction, levels, merge, minhash, stacks, vectors

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]


class Pipelines:
    """Steps by name; names are listed in order and found whatever their case."""

    def __init__(self):
        self._steps: dict[str, tuple[str, Step]] = {}

    def add(self, name: str):
        def keep(f: Step) -> Step:
            self._steps[name.lower()] = (name, f)
            return f

        return keep

    def list(self) -> list[str]:
        return sorted(n for n, _ in self._steps.values())

    def run(self, names: list[str], tables: Tables) -> Tables:
        """Run steps one after the other; an unknown name is an error that lists the known ones."""
        for n in names:
            if n.lower() not in self._steps:
                raise KeyError(f"no pipeline {n!r}; there are {', '.join(self.list())}")
            tables = tables | self._steps[n.lower()][1](tables)
        return tables


PIPELINES = Pipelines()


@PIPELINES.add("distinct-ads")
def _distinct(t: Tables) -> Tables:
    """Ids the greedy order keeps; marks nothing."""
    v = minhash.vectors(t["ads"])
    return {"kept": minhash.greedy_distinct(minhash.by_date(t["ads"]), minhash.buckets(v))}


@PIPELINES.add("mark-unique")
def _mark(t: Tables) -> Tables:
    return {"ads": minhash.mark_unique(t["ads"], (_distinct(t))["kept"])}


@PIPELINES.add("init-vectors")
def _vectors(t: Tables) -> Tables:
    """Vectors and buckets of unique ads that have none."""
    v = vectors.vector_rows(vectors.missing(t["ads"], t["vectors"]) if "vectors" in t else t["ads"].filter("is_unique"))
    new = {"vectors": v, "buckets": vectors.bucket_rows(v)}
    return {k: t[k].unionByName(df) if k in t else df for k, df in new.items()}


@PIPELINES.add("update-levels")
def _levels(t: Tables) -> Tables:
    """Unknown levels of salaries from the tags of their ad's message; those that stay unknown aren't written."""
    tags = t["messages"].select(F.col("id").alias("message_id"), levels.resolve_level(F.col("tags")).alias("level"))
    new = t["ads"].select(F.col("id").alias("ad_id"), "message_id").join(tags, "message_id").groupBy("ad_id").agg(F.max("level").alias("level")).filter("level > 0")
    return {"salaries": merge.update_where(t["salaries"], new, "ad_id", ["level"], F.col("level") == 0)}


@PIPELINES.add("backfill-stacks")
def _stacks(t: Tables) -> Tables:
    """Unique ads without a stack take the one their chat maps to."""
    return {"ads": stacks.backfilled(stacks.with_guids(t["ads"]), t["messages"], t["chats"], t["mapping"], t["stacks"])}


@PIPELINES.add("migrate-ids")
def _ids(t: Tables) -> Tables:
    return merge.migrate_all(t, MESSAGES_SPACE, ADS_SPACE)


#: Namespaces of identifiers made from names, their bytes in mixed-endian order, as hex.
MESSAGES_SPACE, ADS_SPACE = "10b8a76bad9dd11180b400c04fd430c8", "11b8a76bad9dd11180b400c04fd430c8"


#: Words that give a place or a format away, in the order in which they are looked for, for reading places without a plug-in.
PLACE_WORDS = [
    ("белорус", 2), ("беларус", 2), ("минск", 2), ("росси", 1), ("москв", 1), ("петербург", 1), ("новосибирск", 1), ("екатеринбург", 1), ("казань", 1), ("russia", 1), ("moscow", 1),
    ("казахстан", 3), ("алматы", 3), ("узбекистан", 3), ("ташкент", 3), ("армени", 3), ("ереван", 3), ("грузи", 3), ("тбилиси", 3), ("kazakhstan", 3), ("armenia", 3), ("georgia", 3),
    ("европ", 4), ("berlin", 4), ("берлин", 4), ("герман", 4), ("польш", 4), ("сербия", 4), ("кипр", 4), ("germany", 4), ("poland", 4), ("cyprus", 4), ("europe", 4), ("amsterdam", 4), ("london", 4),
    ("usa", 5), ("сша", 5), ("new york", 5), ("california", 5), ("дубай", 6), ("оаэ", 6), ("dubai", 6), ("uae", 6), ("израил", 6), ("israel", 6), ("tel aviv", 6),
]
FORMAT_WORDS = [
    ("из любой точки", 4), ("anywhere", 4), ("worldwide", 4), ("внутри страны", 3), ("within the country", 3), ("удаленно по рф", 3), ("удалённо по рф", 3), ("гибрид", 2), ("hybrid", 2), ("два дня в неделю", 2),
    ("только офис", 1), ("office only", 1), ("on-site", 1), ("onsite", 1), ("в офисе", 1),
]


def by_words(text: Column) -> tuple[Column, Column]:
    """Location and work format of a text: the first word of each list that it holds, 0 for none."""
    t = F.lower(text)

    def first(words: list) -> Column:
        return F.coalesce(*(F.when(F.contains(t, F.lit(w)), F.lit(k)) for w, k in words), F.lit(0))

    return first(PLACE_WORDS), first(FORMAT_WORDS)


def classify_places(ads: DataFrame, extract: Callable[[str], str] | None = None) -> DataFrame:
    """Location and work format of ads that have neither, by a plug-in that answers for a text (``extraction.answers``: a spent quota ends its calls), or by
    words; blank texts aren't read, and where both stay unknown nothing is written."""
    todo = ads.filter("location = 0 AND work_format = 0").select("id", "text")
    if extract is None:
        place, form = by_words(F.col("text"))
        new = todo.filter(F.length(F.trim("text")) > 0).select("id", place.alias("location"), form.alias("work_format"))
    else:
        got = extraction.answers(todo, extract).select("id", extraction.parsed(F.col("answer")).alias("p"))
        new = got.select("id", F.coalesce("p.location", F.lit(0)).alias("location"), F.coalesce("p.work_format", F.lit(0)).alias("work_format"))
    return merge.update_places(ads, new)
