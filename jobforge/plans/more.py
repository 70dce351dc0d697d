"""Queries of text assembly, levels, stacks, identifiers, vectors, reports and reader-side figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobforge.functions import hashing, text
from jobforge.functions.session import cut, table
from jobforge.operators import combine, extraction, levels, merge, minhash, outliers, stacks, stats, vectors
from jobforge.operators.delivery import plain_chat_id
from jobforge.plans import pipelines, reports
from jobforge.plans import sql as S
from jobforge.plans.base import TOP, _split, _top, _with, query
from jobforge.sources import files

# text ---------------------------------------------------------------------------------------------------------------------------------------
query("str1_composed", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents WHERE text IS NOT NULL")(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.encode(text.compose(F.col("text")), "UTF-8"), 256).alias("digest"))
)
query("str9_normalized_entries", f"SELECT id, {S.entry('text')} AS text FROM ads")(lambda s, d: table(s, d, "ads").select("id", text.normalize_entry(text.compose(F.col("text"))).alias("text")))
query("prj3_message_text", f"SELECT id, {S.ad(S.joined('text_entries'))} AS text FROM messages")(lambda s, d: table(s, d, "messages").select("id", text.assemble(F.col("text_entries")).alias("text")))
_FULL = "list_filter(text_entries, lambda e: len(e.text) > 0)"
_RAW = "list_transform(list_filter(text_entries, lambda e: e.type = 'hashtag' AND len(e.text) > 0), lambda e: e.text)"
_lit = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
query("flt4_job_messages", f"""WITH t AS (SELECT id, {S.joined(_FULL)} AS j FROM messages WHERE list_has_any({_RAW}, {_lit(levels.AD_TAGS)}) AND NOT list_has_any({_RAW}, {_lit(levels.SEEKER_TAGS)}))
SELECT id, len({S.ad("j")})::INT AS length FROM t WHERE len(j) >= 300""")(lambda s, d: levels.job_messages(table(s, d, "messages")).select("id", F.length("text").alias("length")))
query("str13_stack_names", "SELECT id, trim(nfc_normalize(lower(name))) AS name FROM technology_stacks")(lambda s, d: table(s, d, "technology_stacks").select("id", text.stack_name(F.col("name")).alias("name")))
query("jsn2_entries_round_trip", "SELECT id, len(text_entries)::INT AS entries, len(list_filter(text_entries, lambda e: e.type = 'hashtag'))::INT AS hashtags FROM messages")(
    lambda s, d: (lambda e: table(s, d, "messages").select("id", e.alias("e")).select("id", F.size("e").alias("entries"), F.size(F.filter("e", lambda x: x["type"] == "hashtag")).alias("hashtags")))(files.entries_from_json(files.entries_json(F.col("text_entries"))))
)
query("set4_locales", "SELECT unnest(['en', 'ru', 'de']) AS locale, unnest([1, 2, 3])::INT AS place")(
    lambda s, d: s.range(1).select(F.posexplode(reports.first_then(F.lit("EN"), F.array(*map(F.lit, ["ru", "en", "RU", "de"])))).alias("p", "locale")).select("locale", (F.col("p") + 1).alias("place"))
)
query("hsh1_fnv_texts")(lambda s, d: table(s, d, "ads").filter("text <> ''").select("id", hashing.fnv1a(F.col("text")).alias("hash")))
query("shg1_shingles", "SELECT id, CASE WHEN len(text) < 5 THEN 0 ELSE len(list_distinct(list_transform(generate_series(1, len(text) - 4), lambda i: substr(text, i, 5)))) END::INT AS n FROM ads")(
    lambda s, d: table(s, d, "ads").select("id", F.size(text.shingle_set(F.col("text"))).alias("n"))
)
query("hsh7_name_guids", f"SELECT id, {S.name_guid(pipelines.MESSAGES_SPACE, 'telegram_id::VARCHAR')} AS guid FROM chats")(
    lambda s, d: table(s, d, "chats").select("id", hashing.name_guid(pipelines.MESSAGES_SPACE, F.col("telegram_id").cast("string")).alias("guid"))
)

# levels -------------------------------------------------------------------------------------------------------------------------------------
query("lvl3_message_levels", f"SELECT level, count(*) AS n FROM (SELECT {S.level('tags')} AS level FROM messages) GROUP BY ALL")(levels.message_levels)
_TAGGED = f"tagged AS (SELECT id AS message_id, max({S.level('tags')}) AS lv FROM messages GROUP BY ALL), ad_level AS (SELECT a.id AS ad_id, max(lv) AS lv FROM ads a JOIN tagged USING (message_id) GROUP BY ALL)"
query("lvl5_backfill", f"WITH {_TAGGED} SELECT CASE WHEN s.level = 0 AND lv > 0 THEN lv ELSE s.level END::INT AS level, count(*) AS n FROM (SELECT DISTINCT * FROM salaries) s LEFT JOIN ad_level USING (ad_id) GROUP BY ALL")(
    lambda s, d: pipelines.PIPELINES.run(["update-levels"], {n: table(s, d, n).distinct() if n == "salaries" else table(s, d, n) for n in ("ads", "messages", "salaries")})["salaries"].groupBy("level").agg(F.count(F.lit(1)).alias("n"))
)
_SAID = [("intern", 1), ("стаж", 1), ("junior", 2), ("джун", 2), ("младш", 2), ("middle", 3), ("мидл", 3), ("senior", 4), ("синьор", 4), ("lead", 5), ("architect", 6)]


def _by_title(t: str) -> int:
    """A level from a text's first line; it stands for an outside service."""
    head = t.split("\n", 1)[0].lower()
    return next(n for w, n in _SAID if w in head)  # no word: an error, which leaves the level unknown


query("lvl4_levels_by_plug_in", f"""WITH {_TAGGED}, h AS (SELECT id, coalesce(lv, 0) AS lv, lower(split_part(text, chr(10), 1)) AS head FROM ads LEFT JOIN ad_level ON ad_id = id)
SELECT CASE WHEN lv > 0 THEN lv {" ".join(f"WHEN contains(head, '{w}') THEN {n}" for w, n in _SAID)} ELSE 0 END::INT AS level, count(*) AS n FROM h GROUP BY ALL""")(
    lambda s, d: levels.with_levels(
        table(s, d, "ads").join(table(s, d, "messages").groupBy(F.col("id").alias("message_id")).agg(F.max(levels.resolve_level(F.col("tags"))).alias("level")), "message_id", "left").select("id", "text", F.coalesce("level", F.lit(0)).alias("level")), "level", _by_title
    ).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
)

# extraction and places -------------------------------------------------------------------------------------------------------------------------


def _answer(t: str) -> str:
    """A canned answer by a text's length; it stands for an outside service."""
    n = len(t)
    if n % 7 == 0:
        raise ValueError("no answer")
    pay = f'"p":true,"lb":{n},"ub":{n * 2},"prd":"month","cur":"{("RUB", "usd", "EUR")[n % 3]}"' if n % 5 else '"p":false,"lb":null,"ub":null,"prd":null,"cur":null'
    return "{" + pay + f',"loc":{n % 8},"fmt":"onSite","pl":"senior"' + "}"


_CANNED = f"""{_TAGGED}, todo AS (SELECT id, date, len(text) AS n, lv FROM ads LEFT JOIN ad_level ON ad_id = id WHERE id NOT IN (SELECT ad_id FROM salaries WHERE ad_id IS NOT NULL) AND len(text) % 7 <> 0)"""


def _extracted(s, d, plug_in=None):
    ads, salaries, messages = (table(s, d, n) for n in ("ads", "salaries", "messages"))
    return extraction.extract(ads, salaries, messages, pipelines.by_words, plug_in)


query("ext1_salaries", f"WITH {_CANNED} SELECT id AS ad_id, date, [3, 1, 2][n % 3 + 1]::INT AS currency, n::DOUBLE AS lower_bound, n * 2.0::DOUBLE AS upper_bound, 2::INT AS period, 1::INT AS status, CASE WHEN lv > 0 THEN lv ELSE 4 END::INT AS level FROM todo WHERE n % 5 <> 0")(
    lambda s, d: _extracted(s, d, _answer)["salaries"]
)
query("ext1_places", f"WITH {_CANNED} SELECT id, (n % 8)::INT AS location, 1::INT AS work_format FROM todo")(lambda s, d: _extracted(s, d, _answer)["places"])
query("sal6_by_rules")(lambda s, d: _extracted(s, d)["salaries"])
_PLACED = "CASE {} ELSE 0 END::INT"
_by = lambda words: _PLACED.format(" ".join(f"WHEN contains(lower(text), '{w}') THEN {k}" for w, k in words))
query("loc2_places", f"""WITH t AS (SELECT location AS l, work_format AS f, {_by(pipelines.PLACE_WORDS)} AS nl, {_by(pipelines.FORMAT_WORDS)} AS nf FROM ads)
SELECT CASE WHEN l = 0 AND f = 0 THEN nl ELSE l END::INT AS location, CASE WHEN l = 0 AND f = 0 THEN nf ELSE f END::INT AS work_format, count(*) AS n FROM t GROUP BY ALL""")(
    lambda s, d: pipelines.classify_places(table(s, d, "ads").select("id", "text", "location", "work_format")).groupBy("location", "work_format").agg(F.count(F.lit(1)).alias("n"))
)
query("snk8_update_places", f"WITH f AS (SELECT id, {_by(pipelines.PLACE_WORDS)} AS nl, {_by(pipelines.FORMAT_WORDS)} AS nf FROM ads WHERE len(text) % 2 = 0) SELECT a.id, CASE WHEN nl > 0 OR nf > 0 THEN nl ELSE location END::INT AS location, CASE WHEN nl > 0 OR nf > 0 THEN nf ELSE work_format END::INT AS work_format FROM ads a LEFT JOIN f USING (id)")(
    lambda s, d: (lambda a, p: merge.update_places(a.select("id", "location", "work_format"), a.filter(F.length("text") % 2 == 0).select("id", p[0].alias("location"), p[1].alias("work_format"))))(table(s, d, "ads"), pipelines.by_words(F.col("text")))
)

# stacks ----------------------------------------------------------------------------------------------------------------------------------------
#: A mapping made of the tables, as a file would give it: two of three chats, in order, with the stacks in order; names in another case and with blanks.
_MAP = "c AS (SELECT telegram_id, name, row_number() OVER (ORDER BY telegram_id) AS k FROM chats), t AS (SELECT id, name, row_number() OVER (ORDER BY name) AS k FROM technology_stacks), mapped AS (SELECT c.telegram_id AS chat, t.id AS stack_id FROM c JOIN t USING (k) WHERE k % 3 <> 0)"
_CHAT_OF = f"chat_of AS (SELECT id AS message_id, min({S.CHAT}) AS chat FROM messages GROUP BY ALL)"


def _mapping(s, d):
    c = table(s, d, "chats").select("telegram_id", F.col("name").alias("channel"), F.expr("row_number() OVER (ORDER BY telegram_id)").alias("k"))  # a file of chats
    t = table(s, d, "technology_stacks").select(F.concat(F.lit(" "), F.upper("name"), F.lit("  ")).alias("stack"), F.expr("row_number() OVER (ORDER BY name)").alias("k"))
    return c.join(t, "k").filter("k % 3 <> 0").select(F.col("telegram_id").alias("chat_id"), "channel", "stack")


def _tables(s, d):
    return table(s, d, "messages"), table(s, d, "chats"), _mapping(s, d), table(s, d, "technology_stacks")


query("jn9_chat_stack", f"WITH {_MAP}, {_CHAT_OF} SELECT a.id, m.stack_id FROM ads a JOIN chat_of USING (message_id) JOIN mapped m USING (chat)")(
    lambda s, d: (lambda m, _c, f, t: stacks.resolved(table(s, d, "ads"), m, f, t).select("id", "stack_id"))(*_tables(s, d))
)
query("jn14_stack_backfill", f"WITH {_MAP}, {_CHAT_OF} SELECT a.id, CASE WHEN a.stack_id IS NULL AND a.is_unique THEN m.stack_id ELSE {S.guid('a.stack_id')} END AS stack_id FROM ads a LEFT JOIN chat_of USING (message_id) LEFT JOIN mapped m USING (chat)")(
    lambda s, d: (lambda m, c, f, t: stacks.backfilled(stacks.with_guids(table(s, d, "ads")), m, c, f, t).select("id", "stack_id"))(*_tables(s, d))
)
query("jn15_assign_stack", f"WITH {_CHAT_OF} SELECT a.id, CASE WHEN a.stack_id IS NULL AND c.telegram_id IS NOT NULL THEN (SELECT id FROM technology_stacks WHERE lower(name) = '.net') ELSE {S.guid('a.stack_id')} END AS stack_id FROM ads a LEFT JOIN chat_of USING (message_id) LEFT JOIN chats c ON c.telegram_id = chat")(
    lambda s, d: stacks.assigned(stacks.with_guids(table(s, d, "ads")), table(s, d, "messages"), table(s, d, "chats"), table(s, d, "technology_stacks"), " .NET").select("id", "stack_id")
)
query("jn13_missing_stacks", "WITH w AS (SELECT DISTINCT trim(nfc_normalize(lower(name))) AS name FROM chats) SELECT name FROM w WHERE name <> '' AND name NOT IN (SELECT trim(nfc_normalize(lower(name))) FROM technology_stacks)")(lambda s, d: merge.missing_names(table(s, d, "technology_stacks"), table(s, d, "chats")))
query("pip1_backfilled_stacks", f"WITH {_MAP}, {_CHAT_OF} SELECT CASE WHEN a.stack_id IS NULL AND a.is_unique THEN m.stack_id ELSE {S.guid('a.stack_id')} END AS stack_id, count(*) AS n FROM ads a LEFT JOIN chat_of USING (message_id) LEFT JOIN mapped m USING (chat) GROUP BY ALL")(
    lambda s, d: (lambda m, c, f, t: pipelines.PIPELINES.run(["Backfill-Stacks"], {"ads": table(s, d, "ads"), "messages": m, "chats": c, "mapping": f, "stacks": t})["ads"].groupBy("stack_id").agg(F.count(F.lit(1)).alias("n")))(*_tables(s, d))
)

# mutations ------------------------------------------------------------------------------------------------------------------------------------------
query("snk1_insert_messages", "SELECT DISTINCT id FROM messages")(lambda s, d: (lambda x: merge.insert_new(x[0].select("id").distinct(), x[1].select("id"), ["id"]))(_split(s, d, "messages")))
query("snk10_deletes", "SELECT name, 0::BIGINT AS n FROM (VALUES ('ads'), ('chats'), ('messages')) t(name)")(
    lambda s, d: s.createDataFrame([("ads",), ("chats",), ("messages",)], "name string").join(merge.cleared(table(s, d, "ads")).select(F.lit("ads").alias("name")).unionAll(merge.cleared(table(s, d, "chats")).select(F.lit("chats"))).unionAll(merge.cleared(table(s, d, "messages")).select(F.lit("messages"))).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
)
_GUID = lambda space, name: S.name_guid(space, name)
_MOVED = f"""place AS (SELECT id, min(telegram_chat_id::VARCHAR || ':' || telegram_message_id::VARCHAR) AS place FROM messages WHERE telegram_chat_id IS NOT NULL AND telegram_message_id IS NOT NULL GROUP BY ALL),
nm AS (SELECT id, {_GUID(pipelines.MESSAGES_SPACE, "place")} AS new FROM place), w AS (SELECT a.id, {_GUID(pipelines.ADS_SPACE, "place || ':ad'")} AS new FROM ads a JOIN place p ON p.id = a.message_id),
na AS (SELECT new, min(id) AS id FROM w WHERE id <> new AND new NOT IN (SELECT id FROM ads) GROUP BY new)"""
query("snk11_migrate_ids", f"""WITH {_MOVED} SELECT 'messages' AS name, coalesce(nm.new, m.id) AS id, NULL AS other, count(*) AS n FROM messages m LEFT JOIN nm USING (id) GROUP BY ALL
UNION ALL SELECT 'ads', coalesce(na.new, a.id), coalesce(nm.new, a.message_id), count(*) FROM ads a LEFT JOIN na USING (id) LEFT JOIN nm ON nm.id = a.message_id GROUP BY ALL
UNION ALL SELECT 'salaries', s.id, coalesce(na.new, s.ad_id), count(*) FROM salaries s LEFT JOIN na ON na.id = s.ad_id GROUP BY ALL""")(
    lambda s, d: (lambda t: t["messages"].select(F.lit("messages").alias("name"), "id", F.lit(None).cast("string").alias("other")).unionAll(t["ads"].select(F.lit("ads"), "id", "message_id")).unionAll(t["salaries"].select(F.lit("salaries"), "id", "ad_id")).groupBy("name", "id", "other").agg(F.count(F.lit(1)).alias("n")))(
        pipelines.PIPELINES.run(["migrate-ids"], {n: table(s, d, n) for n in ("messages", "ads", "salaries")})
    )
)
query("pag2_chunks", "SELECT id, floor((row_number() OVER (ORDER BY id) - 1) / 100)::BIGINT AS chunk FROM ads")(lambda s, d: extraction.chunked(table(s, d, "ads").select("id"), 100, "id").select("id", F.col("chunk").cast("long").alias("chunk")))

# vectors ------------------------------------------------------------------------------------------------------------------------------------------------


def _vector_tables(s, d):
    """Vectors of the first run's unique ads, as they were before the later runs."""
    ads = table(s, d, "ads")
    old = ads.filter("is_unique").join(ads.agg(F.min("created_at").alias("created_at")), "created_at", "left_semi")
    return ads, vectors.vector_rows(old)


_OLD = "SELECT id FROM ads WHERE is_unique AND created_at = (SELECT min(created_at) FROM ads)"
query("ded6_vectors_of", f"SELECT a.id AS ad_id, 1::INT AS version FROM ads a WHERE a.id IN ({_OLD}) AND len(text) % 3 = 0")(
    lambda s, d: (lambda a, v: vectors.get(v, a.filter(F.length("text") % 3 == 0)).select("ad_id", "version"))(*_vector_tables(s, d))
)
query("ded7_missing_vectors", f"SELECT id FROM ads WHERE is_unique AND id NOT IN ({_OLD})")(lambda s, d: (lambda a, v: vectors.missing(a, v).select("id"))(*_vector_tables(s, d)))
query("ded8_model_versions", "SELECT * FROM (VALUES (1::INT, 900000::INT, FALSE), (2::INT, 1000000::INT, TRUE), (3::INT, 1000000::INT, TRUE)) t(version, universe, is_active)")(
    lambda s, d: (lambda held: vectors.model_rows(s, vectors.model_rows(s, held, minhash.Model(version=2)), minhash.Model(version=3)).select("version", "universe", "is_active"))(
        vectors.model_rows(s, vectors.model_rows(s, None, minhash.Model(version=1, universe=900_000)), minhash.Model(version=2, universe=800_000)).withColumn("is_active", F.lit(False))
    )
)
query("ded1_distinct_unnormalised")(lambda s, d: vectors.distinct_unnormalised(table(s, d, "ads")))


def _new_ads(s, d):
    ads = table(s, d, "ads")
    v = cut(vectors.vector_rows(ads), "vectors")
    old = ads.join(ads.agg(F.min("created_at").alias("created_at")), "created_at", "left_semi").select("id")
    held = vectors.get(v, old)
    return ads.select("id").join(old, "id", "left_anti"), v, held, vectors.bucket_rows(held)


query("ded3_not_duplicates")(lambda s, d: vectors.not_duplicates(*_new_ads(s, d), minhash.Model().duplicate))
query("ded5_matches")(lambda s, d: (lambda new, v, _h, b: vectors.matches(b, vectors.bucket_rows(vectors.get(v, new.filter(F.pmod(F.xxhash64("id"), F.lit(1)) == 0)))).groupBy("ad_id").agg(F.count(F.lit(1)).alias("matches")))(*_new_ads(s, d)))

# reports ------------------------------------------------------------------------------------------------------------------------------------------------
_AD = f"""b AS (SELECT * FROM sal WHERE date < DATE '2025-07-01'), m AS (SELECT strftime(date, '%Y %m') AS key, count(*)::DOUBLE AS value FROM b GROUP BY ALL),
l AS ({S.shares("location", stats.LOCATIONS)}), f AS ({S.shares("work_format", stats.FORMATS)}),
r AS (SELECT 'by_month' AS report, 'All' AS series, key, value FROM m
UNION ALL SELECT 'by_month_of_year', 'All', strftime(date, '%m'), count(*)::DOUBLE FROM b GROUP BY ALL UNION ALL SELECT 'by_year', 'All', strftime(date, '%Y'), count(*)::DOUBLE FROM b GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'best_months', 'All', key, value FROM m ORDER BY value DESC, key LIMIT 3)
UNION ALL SELECT 'location', category, key, percent FROM l UNION ALL SELECT 'work_format', category, key, percent FROM f)"""


def _ad_reports(s, d):
    return reports.ad_reports(stats.before_month(stats.salaries(s, d), S.AS_OF), table(s, d, "ads"))


query("rpt1_ad_reports", _with(S.SAL, _AD) + " SELECT * FROM r")(_ad_reports)
#: A locale's words for the queries; files of a site hold the same keys.
WORDS = {f"month.{m}": m[:3].title() for m in reports.MONTHS} | {"variant.all": "Everyone"} | {f"level.{n.lower()}": n.upper() for n in stats.LEVELS}
_MONTH = "[" + ", ".join(f"'{m[:3].title()}'" for m in reports.MONTHS) + "]"
query("str15_localized_reports", _with(S.SAL, _AD) + f""" SELECT report, CASE WHEN series = 'All' THEN 'Everyone' WHEN series = 'Unknown' THEN 'UNKNOWN' ELSE series END AS series,
CASE WHEN regexp_full_match(key, '[0-9]{{4}} [0-9]{{2}}') THEN substr(key, 1, 5) || {_MONTH}[substr(key, 6)::INT] WHEN regexp_full_match(key, '[0-9]{{2}}') THEN {_MONTH}[key::INT] ELSE key END AS key, value FROM r""")(lambda s, d: reports.localized(_ad_reports(s, d), WORDS))
query("str16_localized_levels", _with(S.SAL) + " SELECT upper(['Unknown','Intern','Junior','Middle','Senior','Lead','Architect','Manager'][level + 1]) AS series, count(*) AS n FROM sal WHERE level BETWEEN 0 AND 7 GROUP BY ALL")(
    lambda s, d: stats.salaries(s, d).filter("level BETWEEN 0 AND 7").groupBy(reports.variant_key(stats.names(F.col("level"), stats.LEVELS), WORDS).alias("series")).agg(F.count(F.lit(1)).alias("n"))
)
query("srt1_months_in_order", _with(S.SAL) + " SELECT key, n, row_number() OVER (ORDER BY key)::INT AS place FROM (SELECT strftime(date, '%Y %m') AS key, count(*) AS n FROM sal GROUP BY ALL)")(
    lambda s, d: stats.count_by(stats.salaries(s, d), "year_month").withColumn("place", F.expr("row_number() OVER (ORDER BY key)"))  # the months of a report
)
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS report, series, year::VARCHAR AS key, {m} AS value FROM x WHERE {m} IS NOT NULL" for m in ("min_lower", "max_upper", "mean", "median"))
_NAMES = "['Unknown','Intern','Junior','Middle','Senior','Lead','Architect','Manager'][level + 1]"


def _salary_reports(s, d):
    x = cut(stats.salaries(s, d), "salaries")
    g, v = outliers.remove(x), cut(outliers.remove_by_level(x), "kept")
    own = v.filter("level <> 0")
    return reports.salary_reports(stats.yearly(g, v), stats.yearly(own, own, ["level"]))


query("rpt1_salary_reports", _with(S.SAL, S.kept("g", "sal"), S.kept_by_level("v", "sal"), "own AS (SELECT * FROM v WHERE level <> 0)", "ya AS (WITH " + S.yearly("g", "v") + ")", "yl AS (WITH " + S.yearly("own", "own", "level") + ")",
    f"x AS (SELECT 'All' AS series, year, min_lower, max_upper, mean, median FROM ya UNION ALL SELECT {_NAMES}, year, min_lower, max_upper, mean, median FROM yl)") + " " + _LONG)(_salary_reports)

# reader-side figures ----------------------------------------------------------------------------------------------------------------------------------------
_CMP = _with(S.SAL, S.STACKED, TOP, f"cmp AS (WITH {S.comparison('own', 'stack')})")
query("js1_without_stacks", _with(S.SAL, S.STACKED, TOP) + " SELECT stack, count(*) AS n FROM own WHERE stack NOT IN (SELECT min(stack) FROM top) GROUP BY ALL")(
    lambda s, d: (lambda t: combine.include(t, [r.stack for r in t.agg(F.min("stack").alias("stack")).collect()], exclude=True).groupBy("stack").agg(F.count(F.lit(1)).alias("n")))(_top(s, d))  # one name
)
_LV = f"lv AS (WITH {S.comparison('own', 'stack, level')})"
_ALL = ", ".join(f"coalesce(lv.{c}, 'NaN'::DOUBLE) AS {c}" for c, _ in S.DECILES)
query("js5_one_level", _with(S.SAL, S.STACKED, TOP, _LV) + f" SELECT top.stack, coalesce(lv.jobs, 0)::BIGINT AS jobs, {_ALL} FROM top LEFT JOIN lv ON lv.stack = top.stack AND lv.level = 5")(
    lambda s, d: (lambda t: combine.at_level(stats.stack_comparison(t, ["stack"]), stats.stack_comparison(t, ["stack", "level"]), 5))(_top(s, d))
)
_PTS = f"pts AS (WITH y AS (SELECT *, year(date)::INT AS year FROM own), {S.comparison('y', 'stack, year')})"


def _points(s, d):
    return stats.stack_comparison(_top(s, d).withColumn("year", F.year("date")), ["stack", "year"]).select("year", "median", F.col("median").alias("mean"), F.col("jobs").alias("n"))


query("js9_yearly_largest", _with(S.SAL, S.STACKED, TOP, _PTS) + f" SELECT year, max(CASE WHEN NOT {S.nan('median')} THEN median END) AS value FROM pts GROUP BY year")(lambda s, d: combine.yearly_metric(_points(s, d), "max"))
query("js9_yearly_average", _with(S.SAL, S.STACKED, TOP, _PTS) + f" SELECT year, round(sum(median * jobs) / sum(jobs) + 1e-7, 3) AS value FROM pts WHERE NOT {S.nan('median')} GROUP BY year")(
    lambda s, d: combine.yearly_metric(_points(s, d).filter(~F.isnan("median")), "avg").select("year", stats.steady(F.col("value")).alias("value"))
)
query("js11_selector", _with(S.SAL, S.STACKED, TOP) + " SELECT stack, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, stack)::INT AS rank FROM own GROUP BY stack")(lambda s, d: combine.selector(_top(s, d).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))))
