"""Pieces of SQL shared by the queries' statements for another engine."""

from __future__ import annotations

from jobforge.functions.text import CURRENCY_WORDS
from jobforge.operators.levels import EXACT, PATTERNS
from jobforge.operators.stats import BUCKETS

AS_OF = "2025-07-15"
THIRD = "0.3333333333333333::DOUBLE"

def nan(c: str) -> str:
    """NaN, said so that no statistics of a file can decide it."""
    return f"(CAST({c} AS VARCHAR) = 'nan')"


SAL = f"""sal AS (SELECT DISTINCT id, ad_id, date, level, lower_bound_normalized AS lo, upper_bound_normalized AS hi FROM salaries
  WHERE (lower_bound_normalized >= 0 OR {nan('lower_bound_normalized')}) AND (upper_bound_normalized >= 0 OR {nan('upper_bound_normalized')}))"""
MID = f"CASE WHEN {nan('lo')} THEN hi WHEN {nan('hi')} THEN lo ELSE (lo + hi) / 2 END"


def nonzero(c: str) -> str:
    return f"(abs({c}) > 1e-10 AND NOT {nan(c)})"


def guid(c: str) -> str:
    t = f"lower(trim({c}))"
    h = f"regexp_replace({t}, '[^0-9a-f]', '', 'g')"
    parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN regexp_full_match({t}, '\\{{?[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}}\\}}?') THEN {parts} ELSE {t} END"


STACKED = f"""stacked AS (SELECT s.*, t.name AS stack FROM sal s JOIN (SELECT id AS aid, {guid("stack_id")} AS stack_id FROM ads) a ON a.aid = s.ad_id
  LEFT JOIN technology_stacks t ON t.id = a.stack_id)"""
CHAT = "CASE WHEN telegram_chat_id <= -1000000000000 THEN -telegram_chat_id - 1000000000000 WHEN telegram_chat_id < 0 THEN -telegram_chat_id ELSE telegram_chat_id END"


def r8(values: str, q: float) -> str:
    """Type 8 quantile of a sorted list column."""
    h = f"((len({values}) + {THIRD}) * {q}::DOUBLE + {THIRD})"
    k = f"CAST(floor({h}) AS BIGINT)"
    return f"CASE WHEN {k} < 1 THEN {values}[1] WHEN {k} >= len({values}) THEN {values}[len({values})] ELSE {values}[{k}] + ({h} - {k}) * ({values}[{k} + 1] - {values}[{k}]) END"


def lists(name: str, source: str, groups: str, value: str, where: str = "TRUE") -> str:
    """A table of sorted values by group."""
    g = f"{groups}, " if groups else ""
    return f"{name} AS (SELECT {g}list_sort(list({value})) AS l FROM {source} WHERE {where} AND {value} IS NOT NULL AND NOT {nan(value)}" + (f" GROUP BY {groups})" if groups else ")")


def fences(name: str, source: str, groups: str, bound: str) -> str:
    g = f"{groups}, " if groups else ""
    q1, q3 = r8("l", 0.25), r8("l", 0.75)
    return lists(f"{name}_l", source, groups, f"CASE WHEN {nonzero(bound)} THEN ln({bound}) END", nonzero(bound)) + f""",
{name} AS (SELECT {g}q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM (SELECT {g}{q1} AS q1, {q3} AS q3 FROM {name}_l WHERE len(l) > 0))"""


def outside(v: str, f: str) -> str:
    return f"coalesce({f}.a IS NOT NULL AND NOT {nan(v)} AND ({v} = 0 OR ln(CASE WHEN {v} > 0 THEN {v} END) <= {f}.a OR ln(CASE WHEN {v} > 0 THEN {v} END) >= {f}.b), FALSE)"


def kept(name: str, source: str, cols: str = "s.*") -> str:
    """Rows of ``source`` that the global filter keeps."""
    return fences(f"{name}_f1", source, "", "lo") + ",\n" + fences(f"{name}_f2", source, "", "hi") + f""",
{name} AS (SELECT {cols} FROM {source} s LEFT JOIN {name}_f1 f1 ON TRUE LEFT JOIN {name}_f2 f2 ON TRUE WHERE NOT ({outside("s.lo", "f1")} OR {outside("s.hi", "f2")}))"""


def kept_by_level(name: str, source: str, extra: str = "") -> str:
    """Rows of ``source`` kept inside their level (and ``extra``)."""
    g = f"{extra}, level" if extra else "level"
    on = lambda f: " AND ".join(f"{f}.{c.strip()} IS NOT DISTINCT FROM s.{c.strip()}" for c in g.split(","))
    q = ", ".join(f"{source}.{c.strip()}" for c in g.split(","))
    return f"""{name}_n AS (SELECT *, count(*) OVER (PARTITION BY {q}) AS size FROM {source}),
{name}_big AS (SELECT * FROM {name}_n WHERE size >= 15 AND level <> 0),
{fences(f"{name}_f1", f"{name}_big", g, "lo")},
{fences(f"{name}_f2", f"{name}_big", g, "hi")},
{name} AS (SELECT s.* EXCLUDE (size) FROM {name}_n s LEFT JOIN {name}_f1 f1 ON {on("f1")} LEFT JOIN {name}_f2 f2 ON {on("f2")}
  WHERE s.size < 15 OR s.level = 0 OR NOT ({outside("s.lo", "f1")} OR {outside("s.hi", "f2")}))"""


def yearly(extremes: str, middles: str, groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    using = f"{g}year"
    return f"""ext AS (SELECT {g}year(date)::INT AS year, min(CASE WHEN {nonzero("lo")} THEN lo END) AS min_lower, max(CASE WHEN {nonzero("hi")} THEN hi END) AS max_upper FROM {extremes} GROUP BY ALL),
mids AS (SELECT {g}year(date)::INT AS year, (lo + hi) / 2 AS mid FROM {middles} WHERE {nonzero("lo")} AND {nonzero("hi")}),
{lists("mid_l", "mids", using, "mid")},
mean AS (SELECT {using}, avg(mid) AS mean FROM mids GROUP BY ALL)
SELECT {using}, round(min_lower + 1e-7, 3) AS min_lower, round(max_upper + 1e-7, 3) AS max_upper, round(mean + 1e-7, 3) AS mean, round({r8("l", 0.5)} + 1e-7, 3) AS median
FROM ext FULL JOIN mean USING ({using}) FULL JOIN mid_l USING ({using}) WHERE min_lower IS NOT NULL OR max_upper IS NOT NULL OR mean IS NOT NULL"""


def histogram(source: str, groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    b = ", ".join(f"('{n}', {a}::DOUBLE, {z!r}::DOUBLE)" for n, a, z in BUCKETS)
    on = f"USING ({groups})" if groups else "ON TRUE"
    return f"""mids AS (SELECT {g}{MID} AS mid FROM {source}), ok AS (SELECT * FROM mids WHERE NOT {nan('mid')}),
b(bucket, a, z) AS (VALUES {b}), t AS (SELECT {g}count(*) AS total FROM ok{" GROUP BY " + groups if groups else ""})
SELECT {"ok." + groups + ", " if groups else ""}b.bucket, sum(CASE WHEN mid >= a AND mid < z THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN mid >= a AND mid < z THEN 1 ELSE 0 END) * 100.0::DOUBLE / any_value(total), 6) AS percent
FROM ok CROSS JOIN b JOIN t {on} GROUP BY ALL"""


DECILES = (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))


def statistics(source: str, groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    cols = ", ".join(f"round({r8('l', q)} + 1e-7, 3) AS {n}" for n, q in DECILES)
    return f"""mids AS (SELECT {g}{MID} AS mid FROM {source}), {lists("ml", "mids", groups, "mid")}
SELECT {g}len(l)::BIGINT AS n, round(list_avg(l) + 1e-7, 3) AS mean, {cols} FROM ml WHERE len(l) > 0"""


def comparison(source: str, groups: str) -> str:
    cols = ", ".join(f"coalesce(round({r8('l', q)} + 1e-7, 3), 'NaN'::DOUBLE) AS {n}" for n, q in DECILES)
    using = ", ".join(f"c.{x.strip()}" for x in groups.split(","))
    on = " AND ".join(f"ml.{x.strip()} IS NOT DISTINCT FROM c.{x.strip()}" for x in groups.split(","))
    return f"""mids AS (SELECT {groups}, {MID} AS mid FROM {source}), {lists("ml", "mids", groups, "mid", "mid > 0")},
c AS (SELECT {groups}, count(*) AS jobs FROM {source} GROUP BY {groups})
SELECT {using}, jobs, {cols} FROM c LEFT JOIN ml ON {on}"""


def shares(kind: str, labels: list[str]) -> str:
    v = ", ".join(f"({i}, '{n}')" for i, n in enumerate(labels) if i)
    return f"""WITH names(k, category) AS (VALUES {v}), a AS (SELECT strftime(date, '%Y %m') AS key, {kind} AS k FROM ads WHERE {kind} > 0),
t AS (SELECT key, count(*) AS total FROM a GROUP BY key), c AS (SELECT key, k, count(*) AS n FROM a GROUP BY ALL)
SELECT t.key, names.category, round_even(coalesce(c.n, 0) * 100.0::DOUBLE / t.total, 1) AS percent FROM t CROSS JOIN names LEFT JOIN c ON c.key = t.key AND c.k = names.k"""


RATES = """daily AS (SELECT target, date, avg(value) AS value FROM rates WHERE value > 0 GROUP BY ALL),
span AS (SELECT *, coalesce(lead(date) OVER (PARTITION BY target ORDER BY date) - INTERVAL 1 DAY, date)::DATE AS until FROM daily),
filled AS (SELECT target, unnest(generate_series(date, until, INTERVAL 1 DAY))::DATE AS date, value FROM span)"""


SPACE = r"[\t-\r \x{85}\p{Z}]"


def entry(c: str) -> str:
    """A plain text entry, composed and normalised."""
    t = f"translate(nfc_normalize({c}), '—–', '--')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{Nd}}\\t-\\r \\x{{85}}\\p{{Z}}\\-#$€₽]', '', 'g')"
    t = f"regexp_replace({t}, '{SPACE}+', ' ', 'g')"
    for sign, words in CURRENCY_WORDS:
        for w in words:
            t = f"regexp_replace({t}, '{w.replace('.', chr(92) + '.')}', '{sign + ' ' * (len(w) - 1)}', 'gi')"
    t = f"regexp_replace({t}, '{SPACE}+', ' ', 'g')"
    for _ in range(2):  # no look-around here: what overlaps is met the second time
        t = f"regexp_replace({t}, '(\\p{{Nd}}) (\\p{{Nd}})', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '(?s)^(.*?\\p{{Nd}}) ([$€₽])', '\\1\\2')"
    t = f"regexp_replace({t}, '([\\p{{Nd}}$€₽]) -', '\\1-', 'g')"
    return f"trim(regexp_replace({t}, '- ([\\p{{Nd}}$€₽])', '-\\1', 'g'))"


def ad(c: str) -> str:
    """A text normalised as an ad."""
    return f"trim(regexp_replace(regexp_replace({c}, ' [.,;:]', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


def joined(entries: str) -> str:
    """Entries in one text, plain ones normalised, a blank after each."""
    return f"coalesce(array_to_string(list_transform({entries}, lambda e: (CASE WHEN e.type = 'plain' THEN {entry('e.text')} ELSE nfc_normalize(e.text) END) || ' '), ''), '')"


def level(tags: str) -> str:
    """The highest level among tags."""
    t = "regexp_replace(regexp_replace(lower(trim(t)), '^#', ''), '_{2,}', '_', 'g')"
    exact = " ".join(f"WHEN x = '{w}' THEN {k}" for w, k in EXACT.items())
    fits = " ".join(f"WHEN regexp_matches(x, '{p}') THEN {k}" for p, k in PATTERNS)
    return f"coalesce(list_max(list_transform(list_transform({tags}, lambda t: {t}), lambda x: CASE {exact} {fits} ELSE 0 END)), 0)::INT"


def name_guid(space: str, name: str) -> str:
    """A guid from a namespace and a name (SHA-1, mixed-endian)."""
    h = f"sha1(unhex('{space}') || encode({name}))"
    b = lambda i: f"substr({h}, {2 * i + 1}, 2)"
    low = lambda i, keep, put: f"lower(printf('%02x', (('0x' || {b(i)})::INT & {keep}) | {put}))"
    return " || ".join([b(3), b(2), b(1), b(0), "'-'", b(5), b(4), "'-'", low(7, 15, 80), b(6), "'-'", low(8, 63, 128), b(9), "'-'", *(b(i) for i in range(10, 16))])
