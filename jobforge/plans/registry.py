"""The queries of the core and their SQL."""

from __future__ import annotations

from jobforge.operators import delivery, hotkeys, units
from jobforge.plans import base, more, sql  # noqa: F401 - more adds to the queries of base


G, C = sql.guid("stack_id"), sql.CHAT
P2 = f"SELECT g AS stack_id FROM (SELECT {G} AS g, count(*) AS n FROM ads GROUP BY ALL) WHERE g IS NOT NULL AND n * 20 >= (SELECT count(*) FROM ads)"
P2_STACKS = f"""WITH a AS (SELECT {G} AS stack_id, date, id, text FROM ads),
s AS (SELECT stack_id, count(*) AS n_rows, sum(coalesce(len(text), 0))::BIGINT AS n_chars, min(date) AS first_date, max(date) AS latest_date, count(DISTINCT date) AS n_days FROM a GROUP BY ALL),
d AS (SELECT DISTINCT stack_id, date FROM a WHERE date IS NOT NULL), g AS (SELECT stack_id, date - lag(date) OVER (PARTITION BY stack_id ORDER BY date) AS gap FROM d),
m AS (SELECT stack_id, coalesce(max(gap), 0)::INT AS longest_gap FROM g GROUP BY ALL),
l AS (SELECT stack_id, id AS latest_id, text AS latest_text FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY date DESC NULLS LAST, id DESC) AS k FROM a) WHERE k = 1)
SELECT s.*, coalesce(m.longest_gap, 0)::INT AS longest_gap, l.latest_id, l.latest_text FROM s LEFT JOIN m ON m.stack_id IS NOT DISTINCT FROM s.stack_id JOIN l ON l.stack_id IS NOT DISTINCT FROM s.stack_id"""
P5 = f"SELECT {C} AS telegram_chat_id, telegram_message_id FROM messages WHERE telegram_chat_id IS NOT NULL AND telegram_message_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
P5_CHATS = f"""SELECT {C} AS telegram_chat_id, count(DISTINCT telegram_message_id) AS posts, count(telegram_message_id) AS deliveries, count(*) - count(telegram_message_id) AS unidentified FROM messages GROUP BY ALL"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _units() -> str:
    """The recorded unit of every usable lower bound, with the same expressions as ``operators.units``."""
    blanks = " || ".join(f"chr({ord(c)})" for c in units.BLANKS)
    pay = _text(units.PAY)
    g = lambda i: f"trim(regexp_extract(seg, {pay}, {i}))"

    def unit(c: str, kind: str) -> str:
        stem = f"regexp_extract(regexp_extract({c}, {_text(units.stem_pattern(kind))}, 1), '^(.*?)[^a-zа-я$€₽]*$', 1)"
        return "CASE " + stem + " " + " ".join(f"WHEN {_text(a)} THEN {_text(u)}" for k, a, u in units.ALIASES if k == kind) + " END"

    number = lambda c: f"CASE WHEN regexp_full_match({c}, '[1-9][0-9]{{0,2}}([ .,][0-9]{{3}})+') THEN regexp_replace({c}, '[ .,]', '', 'g')::DOUBLE ELSE TRY_CAST(replace(replace({c}, ',', '.'), ' ', '') AS DOUBLE) END"
    off = lambda k: f"least(coalesce(abs(ln(lower_bound / (nullif(n1, 0) * {k}))), 1e9), coalesce(abs(ln(lower_bound / (nullif(n2, 0) * {k}))), 1e9))"
    return f"""t AS (SELECT id AS ad_id, lower(translate(text, {blanks}, '{" " * len(units.BLANKS)}')) AS plain FROM ads WHERE text IS NOT NULL),
f AS (SELECT ad_id, coalesce(nullif(regexp_extract(plain, {pay}, 0), ''), regexp_extract(translate(plain, '{units.LOOKALIKE[0]}', '{units.LOOKALIKE[1]}'), {pay}, 0)) AS seg FROM t),
p AS (SELECT ad_id, coalesce({unit(g(8), "currency")}, {unit(g(5), "currency")}, {unit(f"{g(1)} || {g(2)}", "currency")}) AS tc, {unit(g(9), "period")} AS tp,
  coalesce(({unit(g(4), "scale")})::BIGINT, ({unit(g(7), "scale")})::BIGINT, 1) AS ts, {number(g(3))} AS n1, {number(g(6))} AS n2 FROM f WHERE seg <> ''),
s AS (SELECT DISTINCT id AS salary_id, ad_id, date, lower_bound, currency AS c, period AS q FROM salaries WHERE lower_bound > 0 AND CAST(lower_bound AS VARCHAR) NOT IN ('nan', 'inf')),
u AS (SELECT salary_id, s.date, lower_bound, coalesce(tc, CASE c WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'RUB' END) AS currency, coalesce(tp, CASE q WHEN 1 THEN 'day' WHEN 3 THEN 'project' ELSE 'month' END) AS period,
  CASE WHEN coalesce(ts, 1) = 1 THEN 1 WHEN {off("ts")} <= {off("1")} THEN 1 ELSE ts END::BIGINT AS scale FROM s LEFT JOIN p USING (ad_id))"""


def p7() -> str:
    return f"WITH {_units()} SELECT salary_id, currency, period, scale FROM u WHERE NOT (currency = 'RUB' AND period = 'month' AND scale = 1)"


def p7_common() -> str:
    factor = "CASE period " + " ".join(f"WHEN '{k}' THEN {a!r}::DOUBLE" for k, (a, _) in units.FACTORS.items()) + " END"
    return f"""WITH {_units()}, {sql.RATES}, l AS (SELECT target, max(date) AS d FROM filled GROUP BY ALL),
r AS (SELECT u.*, CASE WHEN currency = 'RUB' THEN 1.0::DOUBLE ELSE f.value END AS rate FROM u LEFT JOIN l ON l.target = u.currency LEFT JOIN filled f ON f.target = u.currency AND f.date = least(u.date, l.d))
SELECT salary_id, currency, period, scale, round(lower_bound * scale * rate * {factor} + 1e-7, 3) AS rub_month FROM r"""


def queries() -> dict:
    return base.Q | {
        "p2_found": hotkeys.found, "p2_stacks": hotkeys.summaries,
        "p5_found": delivery.found, "p5_chats": delivery.per_chat,
        "p7_found": units.found, "p7_common": units.common_units,
    }


def oracle_sql() -> dict[str, str]:
    return base.SQL | {"p2_found": P2, "p2_stacks": P2_STACKS, "p5_found": P5, "p5_chats": P5_CHATS, "p7_found": p7(), "p7_common": p7_common()}
