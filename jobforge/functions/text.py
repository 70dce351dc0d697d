"""Text normalisation as column expressions (whole-stage code, no Python)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without which a text is composed (NFC) already: marks, conjoining jamo, and letters that have another canonical form.
MAYBE_LOOSE = r"[\p{M}\u0340-\u0341\u0374\u037E\u0387\u1100-\u11FF\u1F71-\u1FFD\u2000-\u2001\u2126\u212A\u212B\u2329\u232A\uF900-\uFAFF\x{2F800}-\x{2FA1F}]"

#: Names of currencies in the order in which they are replaced, and their signs.
CURRENCY_WORDS = [("₽", ["рублей", "рубль", "рубли", "руб", " р ", " р.", " р,"]), ("$", ["долларов", "доллар", "usd"]), ("€", ["euro", "евро", "eur"])]


def compose(c: Column) -> Column:
    """Unicode NFC. Only texts that may not be composed yet are sent to Python, in Arrow batches."""

    @F.pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(nfc(F.when(F.regexp_like(c, F.lit(MAYBE_LOOSE)), c)), c)


def compose_entries(entries: Column) -> Column:
    """Text entries with their texts in NFC; only lists that need it are sent to Python."""

    @F.pandas_udf("array<string>")
    def nfc(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [None if t is None else unicodedata.normalize("NFC", t) for t in x])

    loose = F.exists(entries, lambda e: F.coalesce(F.regexp_like(e["text"], F.lit(MAYBE_LOOSE)), F.lit(False)))
    made = nfc(F.when(loose, F.transform(entries, lambda e: e["text"])))
    return F.when(made.isNull(), entries).otherwise(F.arrays_zip(F.transform(entries, lambda e: e["type"]).alias("type"), made.alias("text")).cast("array<struct<type:string,text:string>>"))


def fold_dashes(c: Column) -> Column:
    return F.translate(c, "—–", "--")


def keep_known(c: Column) -> Column:
    """Letters, digits, white space and - # $ € ₽ only."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{Nd}\s\-#$€₽]", "")


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def currency_signs(c: Column) -> Column:
    """Each name, wherever it stands, becomes its sign and blanks to the same length."""
    for sign, words in CURRENCY_WORDS:
        for w in words:
            c = F.regexp_replace(c, "(?iu)" + w.replace(".", r"\."), sign.replace("$", r"\$") + " " * (len(w) - 1))
    return c


def join_thousands(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\p{Nd}) (?=\p{Nd})", "")


def first_amount_sign(c: Column) -> Column:
    """The blank between a digit and a currency sign goes at its first occurrence only."""
    return F.regexp_replace(c, r"(?s)^(.*?\p{Nd}) ([$€₽])", "$1$2")


def tight_ranges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[\p{Nd}$€₽]) (?=-)|(?<=-) (?=[\p{Nd}$€₽])", "")


def normalize_entry(c: Column) -> Column:
    """A short composed entry (``compose``): dashes, known characters, blanks, currency signs, thousands, ranges."""
    c = one_space(keep_known(fold_dashes(c)))
    c = one_space(currency_signs(c))
    return F.trim(tight_ranges(first_amount_sign(join_thousands(c))))


def drop_loose_separators(c: Column) -> Column:
    """A separator that follows a blank goes."""
    return F.regexp_replace(c, "(?<= )[.,;:]", "")


def normalize_ad(c: Column) -> Column:
    return F.trim(one_space(drop_loose_separators(c)))


def normalize_tag(c: Column) -> Column:
    """Trimmed, lower-cased, without one leading #, runs of _ single."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^#", ""), "_{2,}", "_")


def joined(entries: Column) -> Column:
    """Composed entries in one text: plain ones normalised, others as they are, a blank after each."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.when(e["type"] == "plain", normalize_entry(e["text"])).otherwise(e["text"]), F.lit(" "))), "")


def assemble(entries: Column) -> Column:
    """A message's text: its entries composed and joined, then normalised as an ad."""
    return normalize_ad(joined(compose_entries(entries)))


def stack_name(c: Column) -> Column:
    """A stack's name as it is compared: lower case, composed, trimmed."""
    return F.trim(compose(F.lower(c)))


def shingle_set(c: Column, k: int = 5) -> Column:
    """Distinct substrings of k characters; empty for shorter texts."""
    n = F.length(c)
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(k))))
    return F.when(n >= k, some).otherwise(F.array().cast("array<string>"))
