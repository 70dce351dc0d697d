"""Reports as tidy rows, and their writers. Rows that reach the driver are a report's own, at most a few per month and kind."""

from __future__ import annotations

import datetime as dt
import html
import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobforge.operators import stats

PALETTE = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7"]
VARIANTS = ["All", *stats.LEVELS]


def ad_reports(salaries: DataFrame, ads: DataFrame) -> DataFrame:
    """(report, series, key, value): counts by month, month of year and year, the three best months, and shares of places and formats."""
    tidy = lambda df, name: df.select(F.lit(name).alias("report"), F.lit("All").alias("series"), "key", F.col("n").cast("double").alias("value"))
    months = stats.count_by(salaries, "year_month")
    share = lambda kind, labels: stats.monthly_share(ads, kind, labels).select(F.lit(kind).alias("report"), F.col("category").alias("series"), "key", F.col("percent").alias("value"))
    parts = [tidy(months, "by_month"), tidy(stats.count_by(salaries, "month"), "by_month_of_year"), tidy(stats.count_by(salaries, "year"), "by_year"), tidy(months.orderBy(F.desc("n"), "key").limit(3), "best_months")]
    out = parts[0]
    for p in [*parts[1:], share("location", stats.LOCATIONS), share("work_format", stats.FORMATS)]:
        out = out.unionByName(p)
    return out


def salary_reports(yearly_all: DataFrame, yearly_levels: DataFrame) -> DataFrame:
    """(report, series, key, value) of the four yearly figures, for all rows and for each level."""
    metrics = ["min_lower", "max_upper", "mean", "median"]
    both = yearly_all.withColumn("series", F.lit("All")).unionByName(yearly_levels.withColumn("series", stats.names(F.col("level"), stats.LEVELS)).drop("level"))
    rows = F.array(*(F.struct(F.lit(m).alias("report"), F.col(m).alias("value")) for m in metrics))
    return both.select("series", F.col("year").cast("string").alias("key"), F.inline(rows)).filter("value IS NOT NULL").select("report", "series", "key", "value")


def chart(rows: list, primary: str = "All") -> dict:
    """Labels of the primary series and every series along them; what a series lacks is 0. Colours repeat."""
    labels = sorted({r["key"] for r in rows if r["series"] == primary}) or sorted({r["key"] for r in rows})
    names = sorted({r["series"] for r in rows}, key=lambda n: (VARIANTS.index(n) if n in VARIANTS else 99, n))
    at = {(r["series"], r["key"]): r["value"] for r in rows}
    return {"labels": labels, "datasets": [{"label": n, "color": PALETTE[i % len(PALETTE)], "data": [at.get((n, k), 0) for k in labels]} for i, n in enumerate(names)]}


def finite(v):
    """The same with numbers that aren't finite as null and null members left out."""
    if isinstance(v, dict):
        return {k: finite(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        return [finite(x) for x in v]
    return None if isinstance(v, float) and not math.isfinite(v) else v


def first_then(first: Column, others: Column) -> Column:
    """A list of locales in lower case, once each, with one of them first."""
    return F.array_distinct(F.transform(F.concat(F.array(first), others), F.lower))


def metadata(site: str, base_url: str, locales: list[str], primary: str, published: dt.datetime, kind: str = "Dataset") -> dict:
    """Page metadata with JSON-LD; locales once each, the primary first."""
    seen = list(dict.fromkeys(x.lower() for x in [primary, *locales]))
    return {"site": site, "canonical": f"{base_url.rstrip('/')}/{primary}/", "alternates": {x: f"{base_url.rstrip('/')}/{x}/" for x in seen}, "jsonld": {"@context": "https://schema.org", "@type": kind, "name": site, "datePublished": published.isoformat()}}


def run_folder(root: str, now: dt.datetime) -> Path:
    """A run's folder, by its time in UTC."""
    return Path(root) / now.strftime("%Y%m%d-%H%M%SZ")


def published_at(root: str, now: dt.datetime) -> dt.datetime:
    """The first publication: read from its sidecar where there is one, else written there."""
    p = Path(root) / "published.txt"
    if p.exists():
        return dt.datetime.fromisoformat(p.read_text().strip())
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(now.isoformat())
    return now


def write_html(root: str, now: dt.datetime, charts: dict[str, dict], texts: dict[str, dict[str, str]], meta: dict) -> list[Path]:
    """One page a locale with the charts' data as JSON; a missing text is an error."""
    out = []
    for locale, t in texts.items():
        head = f'<title>{html.escape(t["title"])}</title><link rel="canonical" href="{html.escape(meta["canonical"])}">'
        head += "".join(f'<link rel="alternate" hreflang="{k}" href="{html.escape(v)}">' for k, v in meta["alternates"].items())
        head += f'<script type="application/ld+json">{json.dumps(meta["jsonld"], ensure_ascii=False)}</script>'
        body = page(charts, t)
        p = run_folder(root, now) / locale / "index.html"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f'<!doctype html><html lang="{locale}"><head><meta charset="utf-8">{head}</head><body>{body}<script id="data" type="application/json">{json.dumps(finite(charts), ensure_ascii=False)}</script></body></html>')
        out.append(p)
    return out


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_key(key: Column, texts: dict[str, str]) -> Column:
    """"YYYY MM" and "MM" with the month by name; a month beyond 12 is an error, other keys stay."""
    name = F.create_map(*(x for i, m in enumerate(MONTHS) for x in (F.lit(f"{i + 1:02}"), F.lit(texts[f"month.{m}"]))))
    digits = F.regexp_extract(key, r"^(?:[0-9]{4} )?([0-9]{2})$", 1)
    found = F.coalesce(F.try_element_at(name, digits), F.raise_error(F.concat(F.lit("no month "), digits)))
    return F.when(digits == "", key).when(F.length(key) == 2, found).otherwise(F.concat(F.substring(key, 1, 5), found))


def variant_key(key: Column, texts: dict[str, str]) -> Column:
    """"All" and the names of levels, case aside, in a locale's words; other keys stay."""
    own = {"all": texts["variant.all"], "все": texts["variant.all"], **{n.lower(): texts[f"level.{n.lower()}"] for n in stats.LEVELS}}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.lower(key)), key)


def localized(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Report rows with their keys and series in a locale's words."""
    return rows.withColumn("key", month_key(F.col("key"), texts)).withColumn("series", variant_key(F.col("series"), texts))


#: Reports whose chart takes the whole width of a page.
WIDE = ("by_month", "location", "work_format")


def page(charts: dict[str, dict], texts: dict[str, str]) -> str:
    """The sections of a page: one a report, wide or narrow, with a choice of the series in their order where there are several."""
    out = []
    for code, c in charts.items():
        names = [d["label"] for d in c["datasets"]]
        choice = "".join(f"<option>{html.escape(n)}</option>" for n in names)
        choice = f"<select>{choice}</select>" if len(names) > 1 else ""
        out.append(f'<section id="{html.escape(code)}" class="{"wide" if code in WIDE else "narrow"}"><h2>{html.escape(texts[code])}</h2>{choice}<canvas></canvas></section>')
    return "".join(out)


def console(title: str, rows: list[tuple[str, object]]) -> str:
    """A title, a rule, and keys padded to twenty."""
    return "\n".join([title, "-" * len(title), *(f"{k:<20}{v}" for k, v in rows)])


def number(v: float) -> str:
    """Whole numbers without digits, others with two; thousands apart."""
    return f"{v:,.0f}" if float(v).is_integer() else f"{v:,.2f}"
