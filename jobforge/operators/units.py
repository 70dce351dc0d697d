"""Pay recorded in different units: one regular expression finds the pay phrase, the rest is joins and CASE."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.functions.session import table

#: The pay phrase, on lower-cased text with plain spaces. Groups: 1 and 2 leading currency signs, 3-5 the first number with scale
#: and currency, 6-8 the same of the second number, 9 what follows. Written without look-around, so that RE2 engines read it too.
_NUM = r"([0-9]+(?:[ .,][0-9]+)*)"
_SCALE = r"(млн|миллион[а-я]*|million|mln|тыс[а-я]*|т\.|т |thousand|k|к)?"
_CUR = r"([$€₽]|руб[а-я]*|р[./ !;,\n\r]|roubles?|rub|бакс[а-я]*|долл[а-я]*|usd|dollars?|bucks|евро|euros?|eur)?"
PAY = (
    r"(?:зарплата|зп|оплата|доход|вилка|платим|бюджет|💰|salary|budget|compensation|pay)[\s:—–-]*([$€₽])?\s*"
    r"(?:от|до|максимум|from|up to|at most|max)?\s*([$€₽])?\s*"
    + _NUM + r"\s?" + _SCALE + r"\.?\s?" + _CUR
    + r"(?:[.]?\s*(?:-|–|—|до|to)\s*[$€₽]?" + _NUM + r"\s?" + _SCALE + r"\.?\s?" + _CUR + r")?([^\n\r!;]{0,26})"
)
#: An alias as the text has it, its unit, and the factor and offset to the common unit. What is matched is the alias's stem.
ALIASES = [
    ("currency", "$", "USD"), ("currency", "бакс", "USD"), ("currency", "долл", "USD"), ("currency", "usd", "USD"), ("currency", "dollar", "USD"), ("currency", "buck", "USD"),
    ("currency", "€", "EUR"), ("currency", "евро", "EUR"), ("currency", "eur", "EUR"),
    ("currency", "₽", "RUB"), ("currency", "руб", "RUB"), ("currency", "р", "RUB"), ("currency", "rouble", "RUB"), ("currency", "rub", "RUB"),
    ("period", "час", "hour"), ("period", "hour", "hour"), ("period", "h", "hour"),
    ("period", "день", "day"), ("period", "дневн", "day"), ("period", "day", "day"), ("period", "daily", "day"),
    ("period", "год", "year"), ("period", "year", "year"), ("period", "annual", "year"), ("period", "p.a", "year"),
    ("period", "проект", "project"), ("period", "project", "project"), ("period", "разово", "project"),
    ("period", "мес", "month"), ("period", "ежемес", "month"), ("period", "month", "month"), ("period", "mo", "month"),
    ("scale", "млн", "1000000"), ("scale", "миллион", "1000000"), ("scale", "million", "1000000"), ("scale", "mln", "1000000"),
    ("scale", "тыс", "1000"), ("scale", "т", "1000"), ("scale", "thousand", "1000"), ("scale", "k", "1000"), ("scale", "к", "1000"),
]
#: Months in which one period's pay is earned once, as a factor, and an offset, to reach a month; a project counts as one month.
FACTORS = {"hour": (168.0, 0.0), "day": (21.0, 0.0), "month": (1.0, 0.0), "year": (1 / 12, 0.0), "project": (1.0, 0.0)}
#: Blanks other than the plain one that stand in numbers.
BLANKS = "\u00a0\u202f\u2009\t"
#: Latin letters that stand in for Cyrillic ones in edited copies; only used where the text as written has no pay phrase.
LOOKALIKE = ("aceopxykmtbh", "асеорхукмтвн")


def stem_pattern(kind: str) -> str:
    """Finds the alias with which a text begins, longest first; before a period there may be a dot, a slash and little words."""
    own = sorted((re.escape(a) for k, a, _ in ALIASES if k == kind), key=lambda a: -len(a))
    if kind != "period":
        return "^(" + "|".join(own) + ")"
    return r"^[.\s]*(?:(?:/|в|за|весь|per|fixed|for|the|whole)\s*)*(" + "|".join(a for a in own if a not in ("h", "mo")) + "|(?:h|mo)(?:[^a-z]|$))"


def _stem(c: Column, kind: str) -> Column:
    """The alias of this kind at the start of the text; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_extract(c, stem_pattern(kind), 1), r"^(.*?)[^a-zа-я$€₽]*$", 1), F.lit(""))


def _unit(df: DataFrame, stem: str, kind: str, name: str) -> DataFrame:
    """Join the alias table, which is fixed and has under 50 rows."""
    rows = [(a, u) for k, a, u in ALIASES if k == kind]
    alias = df.sparkSession.createDataFrame(rows, f"{stem} string, {name} string")
    return df.join(F.broadcast(alias), stem, "left").drop(stem)


def _number(c: Column) -> Column:
    """``10 400``, ``1.200`` and ``3,4`` as numbers: groups of three digits are thousands, any other mark is decimal."""
    return F.when(F.regexp_like(c, F.lit(r"^[1-9][0-9]{0,2}([ .,][0-9]{3})+$")), F.regexp_replace(c, "[ .,]", "").cast("double")).otherwise(F.replace(F.replace(c, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double"))


def pay_phrases(ads: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per row of ``ads`` with a pay phrase: ad_id, and what the phrase says (t_currency, t_period, t_scale, n1, n2; null where silent).

    Null and empty texts and texts without pay give no row. The first phrase counts; whole texts are searched."""
    plain = F.lower(F.translate(F.col(text_col), BLANKS, " " * len(BLANKS)))
    found = F.regexp_extract(plain, PAY, 0)
    seg = F.when(found != "", found).otherwise(F.regexp_extract(F.translate(plain, *LOOKALIKE), PAY, 0))
    g = lambda i: F.trim(F.regexp_extract("seg", PAY, i))
    out = (
        ads.select(F.col(id_col).alias("ad_id"), seg.alias("seg"))
        .filter("seg != ''")
        .select("ad_id", F.concat(g(1), g(2)).alias("lead"), *(g(i).alias(f"g{i}") for i in (3, 4, 5, 6, 7, 8)), g(9).alias("tail"))
        .select(
            "ad_id",
            F.coalesce(*(_stem(F.col(c), "currency") for c in ("g8", "g5", "lead"))).alias("s_cur"),
            _stem(F.col("tail"), "period").alias("s_per"),
            F.coalesce(*(_stem(F.col(c), "scale") for c in ("g4", "g7"))).alias("s_scale"),
            _number(F.col("g3")).alias("n1"),
            _number(F.col("g6")).alias("n2"),
        )
    )
    for stem, kind, name in (("s_cur", "currency", "t_currency"), ("s_per", "period", "t_period"), ("s_scale", "scale", "t_scale")):
        out = _unit(out, stem, kind, name)
    return out.withColumn("t_scale", F.coalesce(F.col("t_scale").cast("bigint"), F.lit(1).cast("bigint")))


def recorded_units(salaries: DataFrame, ads: DataFrame) -> DataFrame:
    """The unit of every usable lower bound: salary_id, ad_id, date, lower_bound, currency, period, scale, amount.

    Usable is a number above 0: null, NaN, infinite, -1 and 0 give no row. Rows doubled in full give one row. What the text says decides,
    then the columns, then the source default (roubles a month). The stored number is in the text's scale where it equals the text's
    number as written, in single units where it equals that number times the scale; where it equals neither, the nearer one in ratio counts.
    Salaries without an ad, or whose ad says nothing, keep their columns. Further columns of either table are left out."""
    s = salaries.select(F.col("id").alias("salary_id"), "ad_id", "date", F.col("lower_bound").cast("double").alias("lower_bound"), F.col("currency").alias("c"), F.col("period").alias("p"))
    s = s.filter("lower_bound > 0 AND NOT isnan(lower_bound) AND lower_bound < double('infinity')").distinct()
    x = F.col("lower_bound")
    off = lambda n, k: F.least(*(F.abs(F.ln(x / (F.nullif(F.col(v), F.lit(0.0)) * k))) for v in n))
    as_text, as_units = off(("n1", "n2"), F.lit(1.0)), off(("n1", "n2"), F.col("t_scale"))
    scale = F.when(F.coalesce(F.col("t_scale"), F.lit(1)) == 1, F.lit(1)).when(F.coalesce(as_units, F.lit(0.0)) <= F.coalesce(as_text, F.lit(0.0)), F.lit(1)).otherwise(F.col("t_scale"))
    return (
        s.join(pay_phrases(ads), "ad_id", "left")
        .select(
            "salary_id", "ad_id", "date", "lower_bound",
            F.coalesce("t_currency", F.when(F.col("c") == 1, "USD").when(F.col("c") == 2, "EUR").when(F.col("c") == 3, "RUB"), F.lit("RUB")).alias("currency"),
            F.coalesce("t_period", F.when(F.col("p") == 1, "day").when(F.col("p") == 2, "month").when(F.col("p") == 3, "project"), F.lit("month")).alias("period"),
            scale.cast("bigint").alias("scale"),
        )
        .withColumn("amount", x * F.col("scale"))
    )


def found(spark, sf_dir: str) -> DataFrame:
    """p7_found: salaries not recorded in single roubles per month, with their unit."""
    u = recorded_units(table(spark, sf_dir, "salaries"), table(spark, sf_dir, "ads"))
    return u.filter("NOT (currency = 'RUB' AND period = 'month' AND scale = 1)").select("salary_id", "currency", "period", "scale")


def common_units(spark, sf_dir: str) -> DataFrame:
    """p7_common: every usable lower bound in roubles per month. The rate is that of the last day on or before the salary's date with a
    rate (the mean where a day has several); an amount before the first rate gets null. Factors and offsets are in FACTORS."""
    from jobforge.operators.rates import as_of_rates

    u = recorded_units(table(spark, sf_dir, "salaries"), table(spark, sf_dir, "ads"))
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in FACTORS.items() for x in (k, v[i])))[F.col("period")]
    rated = as_of_rates(u, table(spark, sf_dir, "rates"), "currency", "date")
    return rated.select("salary_id", "currency", "period", "scale", F.round(F.col("amount") * F.col("rate") * pick(0) + pick(1) + 1e-7, 3).alias("rub_month"))
