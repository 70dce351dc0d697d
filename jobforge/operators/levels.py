"""Tags: job ads among messages, and seniority from hashtags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.functions.session import table
from jobforge.functions.text import compose_entries, joined, normalize_ad, normalize_tag

#: Tags of job ads, tags of people looking for work, and the shortest text of an ad.
AD_TAGS = ["#вакансия", "#работа", "#job", "#vacancy", "#fulltime", "#удаленка", "#офис", "#remote", "#удалёнка", "#удаленно", "#parttime", "#гибрид", "#work", "#удаленнаяработа", "#office", "#релокация", "#relocation", "#relocate", "#полная", "#фуллтайм"]
SEEKER_TAGS = ["#резюме", "#ищу"]
SHORTEST = 300
LEVELS = range(8)
#: Tags that name a level exactly, with its number.
EXACT = {
    "intern": 1, "intership": 1, "interships": 1, "trainee": 1, "стажер": 1, "стажёр": 1, "стажерка": 1, "стажировка": 1, "стажировки": 1, "student": 1, "студент": 1, "студенты": 1,
    "junior": 2, "juniorbackend": 2, "juniordeveloper": 2, "juniorsystemsanalyst": 2, "strong_junior": 2, "strongjunior": 2, "jr": 2, "джун": 2, "джуниор": 2, "джуны": 2, "джунытожепрограммисты": 2,
    "middle": 3, "middledeveloper": 3, "middledevops": 3, "middleangular": 3, "middleplus": 3, "mid": 3, "middl": 3, "midddle": 3, "midle": 3, "midlle": 3, "middlle": 3, "mидл": 3, "миддл": 3, "мидл": 3, "мидль": 3, "intermediate": 3,
    "senior": 4, "senior_": 4, "senior_developer": 4, "seniordeveloper": 4, "seniorangular": 4, "seniordevops": 4, "seniorfullstack": 4, "seniornetcoredeveloper": 4, "sr": 4, "senoir": 4, "senor": 4,
    "lead": 5, "leader": 5, "teamlead": 5, "team_lead": 5, "techlead": 5, "тимлид": 5, "техлид": 5, "tehlid": 5, "tl": 5, "tl_senior": 5, "ведущий": 5, "ведущийразработчик": 5, "ведущийразработчикnet": 5, "лид": 5,
    "architect": 6, "applicationarchitect": 6, "systemarchitect": 6, "itarchitect": 6, "solutionarchitect": 6, "solution_architect": 6, "архитектор": 6,
    "manager": 7, "projectmanager": 7, "pm": 7, "cto": 7, "head": 7, "headofit": 7, "руководитель": 7,
}
#: Patterns tried in this order where no tag is exact.
PATTERNS = [("^senior(_|[a-z])?", 4), ("^sr$", 4), ("^seno(i?)r$", 4), ("^mid(d?l?e?)", 3), ("^intermediate$", 3), ("^junior", 2), ("^jr$", 2), ("^джун", 2), ("(^|_)lead$", 5), ("team[_]?lead", 5), ("techlead", 5), ("^tl(_senior)?$", 5), ("^тимлид$", 5), ("^техлид$", 5), ("^ведущий.*", 5), ("[a-z]*architect$", 6), ("^архитектор$", 6), ("manager$", 7), ("projectmanager$", 7), ("^pm$", 7), ("^cto$", 7), ("^head(ofit)?$", 7), ("^руководитель$", 7)]


def tag_level(tag: Column) -> Column:
    """Level of a normalised tag: exact, else by the first fitting pattern, else 0."""
    exact = F.create_map(*(F.lit(x) for tag, level in EXACT.items() for x in (tag, level)))
    by_pattern = F.lit(0)
    for p, level in reversed(PATTERNS):
        by_pattern = F.when(F.regexp_like(tag, F.lit(p)), F.lit(level)).otherwise(by_pattern)
    return F.coalesce(F.try_element_at(exact, tag), by_pattern)


def resolve_level(tags: Column) -> Column:
    """The highest level among tags; 0 for none, null and empty lists."""
    return F.coalesce(F.array_max(F.transform(tags, lambda t: tag_level(normalize_tag(t)))), F.lit(0))


def entries_with_text(entries: Column) -> Column:
    return F.filter(entries, lambda e: F.length(e["text"]) > 0)


def hashtags(entries: Column) -> Column:
    return F.transform(F.filter(entries, lambda e: e["type"] == "hashtag"), lambda e: F.lower(e["text"]))


def valid_messages(messages: DataFrame) -> DataFrame:
    """Empty entries go; messages left without entries or without hashtags go."""
    m = messages.withColumn("text_entries", entries_with_text(F.col("text_entries")))
    return m.filter((F.size("text_entries") > 0) & F.exists("text_entries", lambda e: e["type"] == "hashtag"))


def job_messages(messages: DataFrame) -> DataFrame:
    """Messages with an ad's tag and no seeker's tag among their raw hashtags (case counts), whose joined text is long enough before it is normalised as an ad."""
    raw = F.transform(F.filter("text_entries", lambda e: e["type"] == "hashtag"), lambda e: e["text"])
    lits = lambda xs: F.array(*map(F.lit, xs))
    m = valid_messages(messages).withColumn("_raw", raw).filter(F.arrays_overlap("_raw", lits(AD_TAGS)) & ~F.arrays_overlap("_raw", lits(SEEKER_TAGS)))
    long = m.withColumn("text", joined(compose_entries(F.col("text_entries")))).filter(F.length("text") >= SHORTEST)
    return long.withColumn("text", normalize_ad(F.col("text"))).drop("_raw")


def with_levels(df: DataFrame, level: str, fallback, text: str = "text", id_col: str = "id") -> DataFrame:
    """Levels that are unknown (0 or null) from a plug-in that reads a text; blank texts aren't sent to it, and any error of it or a number that is no
    level leaves the level unknown. The plug-in is a function of one text, called in Arrow batches."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                try:
                    got = int(fallback(t))
                except Exception:  # noqa: BLE001 - whatever an outside service raises
                    got = 0
                out.append(got if got in LEVELS else 0)
            yield pdf[["id"]].assign(level=out)

    todo = df.filter((F.coalesce(level, F.lit(0)) == 0) & (F.length(F.trim(text)) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    new = todo.mapInPandas(run, "id string, level int").select(F.col("id").alias("_id"), F.col("level").alias("_new"))
    out = df.join(new, F.col(id_col).cast("string") == F.col("_id"), "left")
    return out.withColumn(level, F.when(F.coalesce(level, F.lit(0)) == 0, F.coalesce("_new", F.lit(0))).otherwise(F.col(level))).select(*df.columns)


def message_levels(spark, sf_dir: str) -> DataFrame:
    """lvl3_message_levels: messages by resolved level of their tags."""
    m = table(spark, sf_dir, "messages")
    return m.select(resolve_level(F.col("tags")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
