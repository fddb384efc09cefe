"""Prices, areas, dates and numbers out of text (F-09 to F-13, F-22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish months by number, with the short names of cards.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def rounded(c: Column, places: int) -> Column:
    """Half up on the binary value: the one rounding rule of this library."""
    p = float(10**places)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def parse_price_eur(c: Column) -> Column:
    """F-09: points and commas dropped, then the first run of digits."""
    d = F.regexp_extract(F.regexp_replace(c.cast("string"), r"[.,]", ""), r"([0-9]+)", 1)
    return F.when(d != "", d.try_cast("double"))


def parse_area_m2(c: Column) -> Column:
    """F-09: a comma is a decimal point; the first number."""
    d = F.regexp_extract(F.regexp_replace(c.cast("string"), ",", "."), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(d != "", d.try_cast("double"))


def parse_lead_date(c: Column) -> Column:
    """F-09: dd.mm.yyyy only."""
    return F.when(F.trim(c).rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_timestamp(F.trim(c), F.lit("d.M.yyyy")).cast("date"))


def flow_price(c: Column) -> Column:
    """F-10: prices between 30 000 and 50 000 000; others are null."""
    return F.when((c >= 30000) & (c <= 50000000), c)


#: Words before a street's name, in a text; words of a price.
STREETS, PRICE_WORDS = "calle|cl|c/|avenida|avda|av|paseo|plaza|ronda|camino|carretera|ctra|travesia|travesía|via|vía|glorieta|pasaje|cuesta|bulevar", "precio|price|venta|sale"
#: A house number stands behind a street's name, with no word of a price between and no currency after it.
HOUSE = rf"(?i)(?<![\p{{L}}\p{{N}}])((?:{STREETS})(?![\p{{L}}\p{{N}}])(?:(?!{PRICE_WORDS})[\p{{L}} ./'ºª])*?[ ])\d+(?![\d.,]*\s*(?:€|eur))(?![\d.,]*\d)"


def flow_price_pair(text: Column) -> Column:
    """F-10: struct(current, previous) of a text: amounts after a euro sign, else before one; without a sign, different numbers beside a word of a price; else different
    numbers of six to eight digits. A street's house number is no price without a sign, however long."""
    number = lambda x: F.regexp_replace(x, r"[^0-9]", "").try_cast("double")
    fit = lambda a: F.filter(F.transform(a, number), lambda p: (p >= 30000) & (p <= 50000000))
    t = F.coalesce(text, F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    euros = fit(every(r"€\s*([\d.,]+)"))
    before = F.array_distinct(fit(every(r"([0-9][0-9.]*)\s*(?:€|eur)")))
    bare = F.regexp_replace(t, HOUSE, "$1#")
    unsigned = lambda p: F.regexp_extract_all(bare, F.lit(p), F.lit(1))
    near = F.array_distinct(fit(F.concat(unsigned(rf"(?i)(?:{PRICE_WORDS})\D{{0,20}}(\d{{5,8}})"), unsigned(r"(?i)(\d{5,8})\D{0,10}(?:eur|€)"))))
    plain = F.array_distinct(fit(unsigned(r"\b(\d{6,8})\b")))
    found = F.when(F.size(euros) > 0, euros).when(F.size(before) > 0, before).when(F.size(near) > 0, near).otherwise(plain)
    return F.struct(F.get(found, 0).alias("current"), F.get(found, 1).alias("previous"))


def _month(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(F.lower(c).startswith(m[:3]), F.lit(i)).otherwise(out)
    return out


def spanish_date(c: Column) -> Column:
    """F-11: ``26 mar 2026``, ``1 de enero de 2026``, dd/mm/yyyy, dd-mm-yyyy, or a month and a year, in that order."""
    t = F.lower(F.coalesce(c, F.lit("")))
    words = r"([0-9]{1,2})\s+(?:de\s+)?([a-z]{3,10})\s+(?:de\s+)?([0-9]{4})"
    digits = r"([0-9]{1,2})[/\-]([0-9]{1,2})[/\-]([0-9]{4})"
    month = r"([a-z]{3,10})\s+(?:de\s+)?([0-9]{4})"

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_timestamp(F.format_string("%s-%s-%s", y, m.cast("string"), d), F.lit("y-M-d")).cast("date")

    part = lambda p, i: F.regexp_extract(t, p, i)
    long = F.when((part(words, 1) != "") & _month(part(words, 2)).isNotNull(), date(part(words, 3), _month(part(words, 2)), part(words, 1)))
    short = F.when(part(digits, 1) != "", date(part(digits, 3), part(digits, 2), part(digits, 1)))
    only = F.when((part(month, 2) != "") & _month(part(month, 1)).isNotNull(), date(part(month, 2), _month(part(month, 1)), F.lit("1")))
    return F.coalesce(long, short, only)


def epoch_seconds(c: Column) -> Column:
    """F-12: seconds of an epoch number, which is in milliseconds above 1e10."""
    return F.when(c > F.lit(1e10), F.floor(c / 1000)).otherwise(F.floor(c))


def spanish_int(c: Column) -> Column:
    """F-13: points are thousands."""
    return F.regexp_replace(F.trim(c), r"\.", "").try_cast("long")


def spanish_float(c: Column) -> Column:
    """F-13: points are thousands, a comma is the decimal point."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")


def split_district_list(c: Column) -> Column:
    """F-13: districts that a street crosses, written between hyphens or, where there is a slash, between slashes; blanks and empty parts go, null has none."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    parts = F.when(F.contains(text, F.lit("-")) & ~F.contains(text, F.lit("/")), F.split(text, "-")).otherwise(F.split(text, "/"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def dms_to_decimal(c: Column) -> Column:
    """F-13: degrees, minutes and seconds with a hemisphere; a decimal number as it is."""
    p = r"([0-9]+)[º°]\s*([0-9]+)'\s*([0-9]+(?:\.[0-9]+)?)(?:''|\")?\s*([NSEWO])"
    g = lambda i: F.regexp_extract(c, p, i)
    value = g(1).try_cast("double") + g(2).try_cast("double") / 60 + g(3).try_cast("double") / 3600
    return F.when(g(1) != "", F.when(g(4).isin("S", "W", "O"), -value).otherwise(value)).otherwise(F.regexp_replace(c, ",", ".").try_cast("double"))


def area_is_close(a: Column, b: Column) -> Column:
    """F-22: within the larger of 5 m² and 8 %; true if either is missing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(5.0), F.greatest(a, b) * 0.08), F.lit(True))


def price_distance_ratio(a: Column, b: Column) -> Column:
    """F-22: difference as a share of the larger; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def price_is_close(a: Column, b: Column, most: float = 0.15) -> Column:
    """F-22: false if either is missing or not positive."""
    return F.coalesce(price_distance_ratio(a, b) <= most, F.lit(False))


def pct_delta(base: Column, other: Column) -> Column:
    """F-22: change as a share of the base."""
    return F.when(base != 0, F.abs(other - base) / F.abs(base))
