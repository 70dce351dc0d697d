"""The queries of the base operators: a Spark callable and, where SQL can say it, a statement for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobforge.functions import hashing, text
from jobforge.functions.session import cut, table
from jobforge.operators import combine, levels, merge, minhash, outliers, rates, salary, stats
from jobforge.operators.delivery import plain_chat_id
from jobforge.plans import sql as S
from jobforge.sources import files

Q: dict = {}
SQL: dict[str, str] = {}
NAMESPACE = "10b8a76bad9dd11180b400c04fd430c8"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# outliers ---------------------------------------------------------------------------------------------------------------------------
query("out1_global_kept", _with(S.SAL, S.kept("k", "sal")) + " SELECT year(date)::INT AS year, count(*) AS n FROM k GROUP BY ALL")(
    lambda s, d: outliers.remove(stats.salaries(s, d)).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
)
query("out2_level_kept", _with(S.SAL, S.kept_by_level("k", "sal")) + " SELECT level, count(*) AS n FROM k GROUP BY ALL")(
    lambda s, d: outliers.remove_by_level(stats.salaries(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
)
query("out3_yearly_hybrid", _with(S.SAL, S.kept("g", "sal"), S.kept_by_level("v", "sal"), S.yearly("g", "v")))(lambda s, d: stats.hybrid_yearly(stats.salaries(s, d)))

# counts and shares --------------------------------------------------------------------------------------------------------------------
for unit, fmt, name in (("year_month", "%Y %m", "agg1_by_year_month"), ("month", "%m", "agg2_by_month"), ("year", "%Y", "agg3_by_year")):
    query(name, _with(S.SAL) + f" SELECT strftime(date, '{fmt}') AS key, count(*) AS n FROM sal WHERE date < DATE '2025-07-01' GROUP BY ALL")(
        lambda s, d, unit=unit: stats.count_by(stats.before_month(stats.salaries(s, d), S.AS_OF), unit)
    )
query("agg4_by_stack_month", _with(S.SAL, S.STACKED) + " SELECT stack, strftime(date, '%Y %m') AS key, count(*) AS n FROM stacked WHERE stack IS NOT NULL GROUP BY ALL")(
    lambda s, d: stats.with_stacks(s, d).filter("stack IS NOT NULL").groupBy("stack", F.date_format("date", "yyyy MM").alias("key")).agg(F.count(F.lit(1)).alias("n"))
)
query("agg5_location_share", S.shares("location", stats.LOCATIONS))(lambda s, d: stats.monthly_share(table(s, d, "ads"), "location", stats.LOCATIONS))
query("agg6_format_share", S.shares("work_format", stats.FORMATS))(lambda s, d: stats.monthly_share(table(s, d, "ads"), "work_format", stats.FORMATS))
query("agg7_yearly_extremes", _with(S.SAL) + f""" SELECT year(date)::INT AS year, min(CASE WHEN {S.nonzero("lo")} THEN lo END) AS min_lower, max(CASE WHEN {S.nonzero("hi")} THEN hi END) AS max_upper FROM sal GROUP BY ALL""")(
    lambda s, d: stats.salaries(s, d).groupBy(F.year("date").alias("year")).agg(F.min(F.when(outliers.nonzero(F.col("lo")), F.col("lo"))).alias("min_lower"), F.max(F.when(outliers.nonzero(F.col("hi")), F.col("hi"))).alias("max_upper"))
)
query("agg8_yearly_middles", _with(S.SAL, S.kept("g", "sal"), S.yearly("g", "g")))(lambda s, d: (lambda k: stats.yearly(k, k))(cut(outliers.remove(cut(stats.salaries(s, d), "salaries")), "kept")))
query("agg9_yearly_by_level", _with(S.SAL, S.kept_by_level("v0", "sal"), "v AS (SELECT * FROM v0 WHERE level <> 0)", S.yearly("v", "v", "level")))(
    lambda s, d: (lambda k: stats.yearly(k, k, ["level"]))(cut(outliers.remove_by_level(cut(stats.salaries(s, d), "salaries")).filter("level <> 0"), "kept"))
)
query("agg10_hybrid_by_level", _with(S.SAL, S.kept("g", "sal"), S.kept_by_level("v", "sal"), S.yearly("g", "v", "level")))(
    lambda s, d: (lambda x: stats.yearly(outliers.remove(x), outliers.remove_by_level(x), ["level"]))(cut(stats.salaries(s, d), "salaries"))
)
query("agg11_quantiles", _with(S.SAL) + ",\n" + S.statistics("sal", "level"))(lambda s, d: stats.aggregate_statistics(stats.salaries(s, d), ["level"]))
query("agg12_histogram", _with(S.SAL, S.histogram("sal")))(lambda s, d: stats.histogram(stats.salaries(s, d)))
query("agg13_statistics", _with(S.SAL, S.kept_by_level("v", "sal"), S.statistics("v")))(lambda s, d: stats.aggregate_statistics(outliers.remove_by_level(stats.salaries(s, d))))
TOP = "top AS (SELECT stack FROM stacked WHERE stack IS NOT NULL GROUP BY stack HAVING count(*) >= 5 ORDER BY count(*) DESC, stack LIMIT 30), own AS (SELECT * FROM stacked WHERE stack IN (SELECT stack FROM top))"


def _top(s, d):
    x = stats.with_stacks(s, d)
    x = cut(x, "stacked")
    return x.join(stats.top_stacks(x).select("stack"), "stack", "left_semi")


query("agg14_stack_histogram", _with(S.SAL, S.STACKED, TOP, S.histogram("own", "stack")))(lambda s, d: stats.histogram(_top(s, d), ["stack"]))
query("agg14_stack_statistics", _with(S.SAL, S.STACKED, TOP, S.statistics("own", "stack")))(lambda s, d: stats.aggregate_statistics(_top(s, d), ["stack"]))


def _by_stack(s, d):
    once = cut(outliers.remove_by_level(cut(_top(s, d), "top")), "once")
    twice = cut(outliers.remove_by_level(once, extra=["stack"]), "twice")
    return stats.yearly(twice, twice, ["stack"])


query("agg15_yearly_by_stack", _with(S.SAL, S.STACKED, TOP, S.kept_by_level("v1", "own"), S.kept_by_level("v2", "v1", "stack"), S.yearly("v2", "v2", "stack")))(_by_stack)
query("agg16_stack_summary", _with(S.SAL, S.STACKED) + " SELECT stack, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stacked), 6) AS percent FROM stacked WHERE stack IS NOT NULL GROUP BY stack HAVING count(*) >= 5 ORDER BY n DESC, stack LIMIT 30")(
    lambda s, d: stats.stack_summary(stats.with_stacks(s, d))
)
query("agg17_stack_comparison", _with(S.SAL, S.STACKED, "named AS (SELECT * REPLACE (coalesce(stack, '') AS stack) FROM stacked)", S.comparison("named", "stack")))(lambda s, d: stats.stack_comparison(stats.with_stacks(s, d).withColumn("stack", F.coalesce("stack", F.lit(""))), ["stack"]))
query("agg17_stack_level_comparison", _with(S.SAL, S.STACKED, "named AS (SELECT * FROM stacked WHERE stack IS NOT NULL)", S.comparison("named", "stack, level")))(
    lambda s, d: stats.stack_comparison(stats.with_stacks(s, d).filter("stack IS NOT NULL"), ["stack", "level"])
)
query("agg17b_stack_year_comparison", _with(S.SAL, S.STACKED, "named AS (SELECT *, year(date)::INT AS year FROM stacked WHERE stack IS NOT NULL)", S.comparison("named", "stack, year")))(
    lambda s, d: stats.stack_comparison(stats.with_stacks(s, d).filter("stack IS NOT NULL").withColumn("year", F.year("date")), ["stack", "year"])
)
query("agg18_filled_rates", _with(S.RATES) + " SELECT target, date, round(value, 6) AS value FROM filled")(lambda s, d: rates.fill_calendar(rates.daily_mean(table(s, d, "rates"))).select("target", "date", F.round("value", 6).alias("value")))
query("agg19_rate_range", "SELECT target, min(date) AS first_day, max(date) AS last_day, count(DISTINCT date) AS days FROM rates GROUP BY ALL")(
    lambda s, d: table(s, d, "rates").groupBy("target").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("date").alias("days"))
)
query("agg20_sources", _with(S.SAL) + f""", m AS (SELECT id AS message_id, {S.CHAT} AS telegram_id, telegram_message_date::DATE AS day FROM messages),
per AS (SELECT telegram_id, min(day) AS first_day, max(day) AS last_day, count(*) AS messages FROM m GROUP BY ALL),
s AS (SELECT telegram_id, count(*) AS salaries, sum(CASE WHEN date BETWEEN DATE '2025-06-01' AND DATE '2025-06-30' THEN 1 ELSE 0 END) AS last_month FROM sal JOIN (SELECT id AS aid, message_id FROM ads) a ON a.aid = sal.ad_id JOIN (SELECT DISTINCT message_id, telegram_id FROM m) m2 USING (message_id) GROUP BY ALL)
SELECT c.telegram_id, lower(trim(c.name)) AS name, first_day, last_day, messages, coalesce(salaries, 0)::BIGINT AS salaries, coalesce(last_month, 0)::BIGINT AS last_month FROM chats c JOIN per USING (telegram_id) LEFT JOIN s USING (telegram_id)""")(
    lambda s, d: stats.source_counts(s, d, S.AS_OF)
)
query("agg21_distinct_levels", "SELECT DISTINCT level FROM salaries")(lambda s, d: table(s, d, "salaries").select("level").distinct())
query("agg22_pending", "SELECT count(*) AS n FROM ads WHERE id NOT IN (SELECT ad_id FROM salaries WHERE ad_id IS NOT NULL)")(
    lambda s, d: table(s, d, "ads").join(table(s, d, "salaries").select(F.col("ad_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
)
query("agg23_stacks_by_place", f"""SELECT location, work_format, array_to_string(list_sort(list(DISTINCT {S.guid("stack_id")})), ' ') AS stacks FROM ads WHERE stack_id IS NOT NULL GROUP BY ALL""")(
    lambda s, d: stats.ads(s, d).filter("stack_id IS NOT NULL").groupBy("location", "work_format").agg(F.array_join(F.sort_array(F.collect_set("stack_id")), " ").alias("stacks"))
)
query("agg26_metadata", _with(S.SAL, S.STACKED) + " SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n, count(DISTINCT stack) AS stacks FROM stacked")(
    lambda s, d: stats.with_stacks(s, d).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"), F.countDistinct("stack").alias("stacks"))
)

# filters and projections ----------------------------------------------------------------------------------------------------------------
query("flt1_unique_view", "SELECT id, date FROM ads WHERE is_unique")(lambda s, d: table(s, d, "ads").filter("is_unique").select("id", "date"))
query("flt2_valid_messages", "SELECT id, len(list_filter(text_entries, lambda e: len(e.text) > 0))::INT AS entries FROM messages WHERE len(list_filter(text_entries, lambda e: e.type = 'hashtag' AND len(e.text) > 0)) > 0")(
    lambda s, d: levels.valid_messages(table(s, d, "messages")).select("id", F.size("text_entries").alias("entries"))
)
_TAGS = "list_transform(list_filter(text_entries, lambda e: e.type = 'hashtag' AND len(e.text) > 0), lambda e: e.text)"
_lit = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
query("flt3_tagged_messages", f"SELECT id FROM messages WHERE list_has_any({_TAGS}, {_lit(levels.AD_TAGS)}) AND NOT list_has_any({_TAGS}, {_lit(levels.SEEKER_TAGS)})")(
    lambda s, d: (lambda raw: levels.valid_messages(table(s, d, "messages")).withColumn("raw", raw).filter(F.arrays_overlap("raw", F.array(*map(F.lit, levels.AD_TAGS))) & ~F.arrays_overlap("raw", F.array(*map(F.lit, levels.SEEKER_TAGS)))).select("id"))(
        F.transform(F.filter("text_entries", lambda e: e["type"] == "hashtag"), lambda e: e["text"])
    )
)
query("flt5_before_month", "SELECT id, date FROM salaries WHERE date < DATE '2025-07-01'")(lambda s, d: stats.before_month(table(s, d, "salaries"), S.AS_OF).select("id", "date"))
query("flt6_date_range", "SELECT id, date FROM salaries WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'")(lambda s, d: table(s, d, "salaries").filter(F.col("date").between("2024-03-01", "2024-09-30")).select("id", "date"))
query("flt7_last_month", "SELECT id, date FROM ads WHERE date BETWEEN DATE '2025-06-01' AND DATE '2025-06-30'")(
    lambda s, d: (lambda a: table(s, d, "ads").filter(F.col("date").between(a, F.last_day(a))).select("id", "date"))(F.add_months(F.trunc(F.lit(S.AS_OF).cast("date"), "MM"), -1))
)
query("flt8_known", "SELECT id, location, work_format FROM ads WHERE stack_id IS NOT NULL AND location <> 0 AND work_format <> 0")(lambda s, d: table(s, d, "ads").filter("stack_id IS NOT NULL AND location <> 0 AND work_format <> 0").select("id", "location", "work_format"))
query("flt9_positive", _with(S.SAL) + f" SELECT id, {S.MID} AS mid FROM sal WHERE NOT {S.nan(S.MID)} AND {S.MID} > 0")(lambda s, d: stats.salaries(s, d).select("id", stats.midpoint().alias("mid")).filter(stats.positive(F.col("mid"))))
query("flt10_nonzero", _with(S.SAL) + f" SELECT id, lo FROM sal WHERE {S.nonzero('lo')}")(lambda s, d: stats.salaries(s, d).filter(outliers.nonzero(F.col("lo"))).select("id", "lo"))
query("flt11_in_set", "SELECT id FROM ads WHERE message_id IN (SELECT id FROM messages WHERE len(tags) > 0)")(lambda s, d: table(s, d, "ads").join(table(s, d, "messages").filter(F.size("tags") > 0).select(F.col("id").alias("message_id")), "message_id", "left_semi").select("id"))
query("flt12_unclassified", "SELECT id FROM ads WHERE location = 0 AND work_format = 0")(lambda s, d: table(s, d, "ads").filter("location = 0 AND work_format = 0").select("id"))
query("prj2_hashtags", "SELECT id, array_to_string(list_transform(list_filter(text_entries, lambda e: e.type = 'hashtag'), lambda e: lower(e.text)), ' ') AS tags FROM messages")(
    lambda s, d: table(s, d, "messages").select("id", F.array_join(levels.hashtags(F.col("text_entries")), " ").alias("tags"))
)
query("prj4_midpoint", _with(S.SAL) + f" SELECT id, {S.MID} AS mid FROM sal")(lambda s, d: stats.salaries(s, d).select("id", stats.midpoint().alias("mid")))
query("prj5_labels", "SELECT id, ['Unknown','Russia','Belarus','Cis','Europe','Us','MiddleEast','Other'][location + 1] AS location, ['Unknown','OnSite','Hybrid','RemoteDomestic','RemoteWorldwide'][work_format + 1] AS work_format FROM ads")(
    lambda s, d: table(s, d, "ads").select("id", stats.names(F.col("location"), stats.LOCATIONS).alias("location"), stats.names(F.col("work_format"), stats.FORMATS).alias("work_format"))
)

# joins -----------------------------------------------------------------------------------------------------------------------------------
query("jn1_unique_salaries", _with(S.SAL) + " SELECT sal.id, sal.date FROM sal JOIN ads a ON a.id = sal.ad_id WHERE a.is_unique")(
    lambda s, d: stats.salaries(s, d).join(table(s, d, "ads").filter("is_unique").select(F.col("id").alias("ad_id")), "ad_id").select("id", "date")
)
query("jn2_with_stack", _with(S.SAL, S.STACKED) + " SELECT id, stack FROM stacked WHERE stack IS NOT NULL")(lambda s, d: stats.with_stacks(s, d).filter("stack IS NOT NULL").select("id", "stack"))
query("jn3_by_chat", f"SELECT {S.CHAT} AS chat, count(*) AS n FROM salaries s JOIN ads a ON a.id = s.ad_id JOIN messages m ON m.id = a.message_id GROUP BY ALL")(
    lambda s, d: table(s, d, "salaries").select("ad_id").join(table(s, d, "ads").select(F.col("id").alias("ad_id"), "message_id"), "ad_id").join(table(s, d, "messages").select(F.col("id").alias("message_id"), plain_chat_id(F.col("telegram_chat_id")).alias("chat")), "message_id").groupBy("chat").agg(F.count(F.lit(1)).alias("n"))
)
query("jn4_left_stack", _with(S.SAL, S.STACKED) + " SELECT id, stack FROM stacked")(lambda s, d: stats.with_stacks(s, d).select("id", "stack"))
query("jn5_ads_without_salary", "SELECT id FROM ads a WHERE NOT EXISTS (SELECT 1 FROM salaries s WHERE s.ad_id = a.id)")(lambda s, d: table(s, d, "ads").join(table(s, d, "salaries").select(F.col("ad_id").alias("id")), "id", "left_anti").select("id"))
query("jn6_new_messages", "SELECT id FROM messages WHERE id NOT IN (SELECT message_id FROM ads WHERE message_id IS NOT NULL)")(lambda s, d: table(s, d, "messages").join(table(s, d, "ads").select(F.col("message_id").alias("id")), "id", "left_anti").select("id"))
query("jn7_chats_with_messages", f"SELECT id FROM chats c WHERE EXISTS (SELECT 1 FROM messages m WHERE {S.CHAT} = c.telegram_id)")(
    lambda s, d: table(s, d, "chats").join(table(s, d, "messages").select(plain_chat_id(F.col("telegram_chat_id")).alias("telegram_id")), "telegram_id", "left_semi").select("id")
)
query("jn8_lookup", "SELECT s.id, a.location, a.work_format FROM salaries s JOIN ads a ON a.id = s.ad_id")(lambda s, d: table(s, d, "salaries").select("id", "ad_id").join(table(s, d, "ads").select(F.col("id").alias("ad_id"), "location", "work_format"), "ad_id").select("id", "location", "work_format"))
query("jn10_chat_counts", f"SELECT c.telegram_id, min(m.telegram_message_date)::DATE AS first_day, count(*) AS n FROM chats c JOIN messages m ON {S.CHAT} = c.telegram_id GROUP BY ALL")(
    lambda s, d: table(s, d, "chats").select("telegram_id").join(table(s, d, "messages").select(plain_chat_id(F.col("telegram_chat_id")).alias("telegram_id"), "telegram_message_date").groupBy("telegram_id").agg(F.to_date(F.min("telegram_message_date")).alias("first_day"), F.count(F.lit(1)).alias("n")), "telegram_id")
)
query("jn11_fx_lookup", _with(S.RATES) + ", s AS (SELECT DISTINCT id, date, currency FROM salaries) SELECT s.id, CASE WHEN s.currency = 3 THEN 1.0 ELSE round(coalesce(f.value, 0.0), 6) END AS rate FROM s LEFT JOIN filled f ON f.date = s.date AND f.target = CASE s.currency WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END")(
    lambda s, d: salary.exact_rates(table(s, d, "salaries").select("id", "date", "currency").distinct(), table(s, d, "rates")).select("id", F.round("rate", 6).alias("rate"))
)

# sorts, limits, sets ----------------------------------------------------------------------------------------------------------------------
query("srt2_stacks_by_median", _with(S.SAL, S.STACKED, TOP) + f""", cmp AS (WITH {S.comparison("own", "stack")}) SELECT stack, jobs, median, row_number() OVER (ORDER BY {S.nan("median")}, median DESC, stack)::INT AS rank FROM cmp""")(
    lambda s, d: stats.sorted_by_median(stats.stack_comparison(_top(s, d), ["stack"])).select("stack", "jobs", "median", "rank")
)
query("top1_months", _with(S.SAL) + " SELECT strftime(date, '%Y %m') AS key, count(*) AS n FROM sal GROUP BY ALL ORDER BY n DESC, key LIMIT 3")(lambda s, d: stats.count_by(stats.salaries(s, d), "year_month").orderBy(F.desc("n"), "key").limit(3))
query("top2_stacks", _with(S.SAL, S.STACKED) + " SELECT stack, count(*) AS n FROM stacked WHERE stack IS NOT NULL GROUP BY stack HAVING count(*) >= 5 ORDER BY n DESC, stack LIMIT 30")(lambda s, d: stats.top_stacks(stats.with_stacks(s, d)))
query("top3_first", "SELECT min(date) AS first_day FROM ads")(lambda s, d: table(s, d, "ads").agg(F.min("date").alias("first_day")))
query("pag1_page", "SELECT id FROM ads ORDER BY id LIMIT 50 OFFSET 100")(lambda s, d: table(s, d, "ads").select("id").orderBy("id").offset(100).limit(50))
query("set1_union_all", "SELECT id FROM ads UNION ALL SELECT ad_id FROM salaries")(lambda s, d: table(s, d, "ads").select("id").unionAll(table(s, d, "salaries").select("ad_id")))
query("set2_union", "SELECT id FROM ads UNION SELECT ad_id FROM salaries")(lambda s, d: table(s, d, "ads").select("id").union(table(s, d, "salaries").select("ad_id")).distinct())
query("set3_except", "SELECT id FROM ads EXCEPT SELECT ad_id FROM salaries")(lambda s, d: table(s, d, "ads").select("id").subtract(table(s, d, "salaries").select("ad_id")))

# text, hashes -----------------------------------------------------------------------------------------------------------------------------
query("str10_normalized_ads", "SELECT id, trim(regexp_replace(regexp_replace(text, ' [.,;:]', ' ', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS text FROM ads")(lambda s, d: table(s, d, "ads").select("id", text.normalize_ad(F.col("text")).alias("text")))
query("str12_tags", "SELECT tag, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(lower(trim(unnest(tags))), '^#', ''), '_{2,}', '_', 'g') AS tag FROM messages) GROUP BY ALL")(
    lambda s, d: table(s, d, "messages").select(F.explode("tags").alias("t")).groupBy(text.normalize_tag(F.col("t")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
)
query("dat_parts", "SELECT id, year(date)::INT AS year, strftime(date, '%m') AS month, date_trunc('month', date)::DATE AS first_day, last_day(date) AS last_day FROM ads")(
    lambda s, d: table(s, d, "ads").select("id", F.year("date").alias("year"), F.date_format("date", "MM").alias("month"), F.trunc("date", "MM").alias("first_day"), F.last_day("date").alias("last_day"))
)
query("mth_roundings", "SELECT target, date, round_even(value, 1) AS even, round(value, 4) AS away FROM (SELECT DISTINCT target, date, value FROM rates)")(
    lambda s, d: table(s, d, "rates").select("target", "date", "value").distinct().select("target", "date", F.bround("value", 1).alias("even"), F.round("value", 4).alias("away"))
)
query("hsh5_sha256", "SELECT id, sha256(text) AS digest FROM ads WHERE text IS NOT NULL")(lambda s, d: table(s, d, "ads").filter("text IS NOT NULL").select("id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")))

# distinct ads ------------------------------------------------------------------------------------------------------------------------------
query("ded2_distinct")(minhash.distinct_ads)
query("ded4_vectors")(lambda s, d: minhash.vectors(table(s, d, "ads")).select("id", "shingles", F.sha2(F.to_json("signature"), 256).alias("digest")))
query("jn12_buckets")(lambda s, d: minhash.buckets(minhash.vectors(table(s, d, "ads"))))
query("ded3_near_pairs")(lambda s, d: minhash.near_pairs(minhash.vectors(table(s, d, "ads")), minhash.Model().duplicate))
query("snk7_mark_unique")(lambda s, d: minhash.mark_unique(table(s, d, "ads"), minhash.distinct_ads(s, d)).select("id", "is_unique"))

# tags and salaries ---------------------------------------------------------------------------------------------------------------------------
_B = lambda c: f"CASE WHEN {c} IS NULL OR {c} = -1 THEN 'NaN'::DOUBLE ELSE {c} END"
query("sal_normalized", _with(S.RATES) + f""", s AS (SELECT DISTINCT id, ad_id, date, currency, lower_bound, upper_bound, period FROM salaries), b AS (SELECT *, {_B("lower_bound")} AS l, {_B("upper_bound")} AS u FROM s),
o AS (SELECT *, CASE WHEN {S.nan("l")} THEN u WHEN {S.nan("u")} THEN l ELSE least(l, u) END AS lo, CASE WHEN {S.nan("u")} THEN l WHEN {S.nan("l")} THEN u ELSE greatest(l, u) END AS hi FROM b),
r AS (SELECT o.*, CASE WHEN o.currency = 3 THEN 1.0 ELSE coalesce(f.value, 0.0) END AS rate, CASE WHEN coalesce(period, 0) IN (0, 3) THEN 4 WHEN coalesce(currency, 0) = 0 THEN 3 WHEN {S.nan("lo")} THEN 3 ELSE 2 END AS status FROM o LEFT JOIN filled f ON f.date = o.date AND f.target = CASE o.currency WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END)
SELECT id, CASE WHEN status = 2 THEN round(lo * rate, 4) ELSE 0.0 END AS lower, CASE WHEN status = 2 THEN round(hi * rate, 4) ELSE 0.0 END AS upper, status::INT AS status FROM r""")(salary.normalized)

# mutations -----------------------------------------------------------------------------------------------------------------------------------
_FIRST = "(SELECT min(created_at) FROM {0})"


def _split(s, d, name):
    t = table(s, d, name)
    first = t.groupBy("created_at").agg(F.count(F.lit(1)).alias("n")).orderBy("created_at").limit(1).select("created_at")
    return t.join(first, "created_at", "left_semi"), t.join(first, "created_at", "left_anti")


query("snk3_upsert_chats", f"""WITH inc AS (SELECT {S.CHAT} AS telegram_id, max(telegram_message_date) AS updated_at FROM messages GROUP BY ALL)
SELECT coalesce(c.telegram_id, i.telegram_id) AS telegram_id, c.name, coalesce(i.updated_at, c.updated_at) AS updated_at FROM chats c FULL JOIN inc i ON i.telegram_id = c.telegram_id""")(
    lambda s, d: merge.upsert(
        table(s, d, "chats").select("telegram_id", "name", "updated_at"),
        table(s, d, "messages").groupBy(plain_chat_id(F.col("telegram_chat_id")).alias("telegram_id")).agg(F.max("telegram_message_date").alias("updated_at")).withColumn("name", F.lit(None).cast("string")), ["telegram_id"], ["updated_at"]
    )
)
query("snk15_finite_json", f"SELECT count(*) AS n FROM salaries WHERE {S.nan('lower_bound_normalized')} OR {S.nan('upper_bound_normalized')}")(
    lambda s, d: files.finite_json(table(s, d, "salaries").select("id", F.col("lower_bound_normalized").alias("l"), F.col("upper_bound_normalized").alias("u"))).filter("get_json_object(json, '$.l') IS NULL OR get_json_object(json, '$.u') IS NULL").agg(F.count(F.lit(1)).alias("n"))
)

# recombination ---------------------------------------------------------------------------------------------------------------------------------
query("js2_combined_histogram", _with(S.SAL, S.STACKED, TOP, "h AS (WITH " + S.histogram("own", "stack") + ")") + " SELECT bucket, sum(n)::BIGINT AS n, round(sum(n) * 100.0::DOUBLE / sum(sum(n)) OVER (), 6) AS percent FROM h GROUP BY bucket")(
    lambda s, d: combine.distributions(stats.histogram(_top(s, d), ["stack"]))
)
query("js3_combined_statistics", _with(S.SAL, S.STACKED, TOP, "h AS (WITH " + S.statistics("own", "stack") + ")") + " SELECT sum(n)::BIGINT AS n, " + ", ".join(f"floor(sum({c} * n) / sum(n) + 0.5)::DOUBLE AS {c}" for c in ("mean", "p10", "p25", "median", "p75", "p90")) + " FROM h")(
    lambda s, d: combine.averaged(stats.aggregate_statistics(_top(s, d), ["stack"]))
)
query("js4_share", _with(S.SAL, S.STACKED, TOP) + " SELECT stack, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM own GROUP BY stack")(lambda s, d: combine.share(_top(s, d).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))))
query("js6_search", _with(S.SAL, S.STACKED, TOP) + f", cmp AS (WITH {S.comparison('own', 'stack')}) SELECT stack, median FROM cmp WHERE contains(lower(stack), 'p') ORDER BY {S.nan("median")}, median DESC, stack LIMIT 5")(
    lambda s, d: combine.search(stats.stack_comparison(_top(s, d), ["stack"]), "P").select("stack", "median")
)
query("js7_weighted_median", _with(S.SAL, S.STACKED, TOP) + f""", cmp AS (WITH y AS (SELECT *, year(date)::INT AS year FROM own), {S.comparison("y", "stack, year")}), ok AS (SELECT year, median, sum(jobs) AS w FROM cmp WHERE NOT {S.nan("median")} GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY year ORDER BY median) AS c, sum(w) OVER (PARTITION BY year) AS t FROM ok) SELECT year, min(median) AS weighted_median FROM r WHERE c >= t / 2.0 GROUP BY year""")(
    lambda s, d: combine.weighted_median(stats.stack_comparison(_top(s, d).withColumn("year", F.year("date")), ["stack", "year"]).filter(~F.isnan("median")), ["year"], "median", "jobs")
)
query("js8_padded_years", "WITH y AS (SELECT year(date)::INT AS year, count(*) AS n FROM ads GROUP BY ALL), r AS (SELECT unnest(generate_series(min(year), greatest(max(year), 2027))) AS year FROM y) SELECT r.year::INT AS year, coalesce(n, 0)::BIGINT AS n FROM r LEFT JOIN y USING (year)")(
    lambda s, d: combine.padded_years(table(s, d, "ads").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n")), "year", "n", 2027)
)
query("js10_axis_step", _with(S.SAL) + " , m AS (SELECT level, count(*) AS n FROM sal GROUP BY ALL), r AS (SELECT level, n * 1.05::DOUBLE / 5 AS raw FROM m), p AS (SELECT *, pow(10.0::DOUBLE, floor(log10(raw))) AS p FROM r) SELECT level, CASE WHEN raw / p <= 1 THEN p WHEN raw / p <= 2 THEN p * 2 WHEN raw / p <= 5 THEN p * 5 ELSE p * 10 END AS step FROM p")(
    lambda s, d: stats.salaries(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", combine.nice_step(F.col("n")).alias("step"))
)
query("js12_stack_hues", "SELECT name, (list_reduce(list_prepend(0::BIGINT, list_transform(generate_series(1, len(name)), lambda i: unicode(substr(name, i, 1))::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295) % 360)::INT AS hue FROM technology_stacks")(
    lambda s, d: table(s, d, "technology_stacks").select("name", combine.stable_hue(F.col("name")).alias("hue"))
)
