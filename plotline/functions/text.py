"""Text, phone, URL, portal and property-type normalisation as Column functions (F-01 to F-09, F-17, F-35)."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with marks, and what they are without.
_MARKED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűųñńņňçćĉċčýÿŷśŝşšźżžğĝġģĥĵķĺļľŕŗřţťŵ"
_PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuunnnncccccyyysssszzzgggghjklllrrrttw"
#: Portals in the order in which their tokens are looked for.
PORTALS = [("idealista", ["idealista"], "Idealista"), ("fotocasa", ["fotocasa"], "Fotocasa"), ("habitaclia", ["habitaclia"], "Habitaclia"), ("milanuncios", ["milanuncios"], "Milanuncios"), ("pisos", ["pisos"], "Pisos"), ("yaencontre", ["yaencontre"], "Yaencontre")]
#: Property types and their families.
PROPERTY_TYPES = {"piso": "residential_standard", "apartamento": "residential_standard", "estudio": "residential_standard", "atico": "residential_standard", "duplex": "residential_standard", "chalet": "residential_standard", "casa": "residential_standard", "local": "retail_office", "oficina": "retail_office", "garaje": "other", "trastero": "other"}
#: Words that do not tell a street; the matcher's list has two more.
FRAGMENT_WORDS = ["calle", "cl", "avenida", "av", "paseo", "ps", "plaza", "pl", "carretera", "camino", "via"]
FRAGMENT_WORDS_MATCHER = [*FRAGMENT_WORDS, "ronda", "travesia"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(c: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` over columns that cost much: the filter stays above them, so nothing is computed twice to be filtered first."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")


def compiled_apart(df: DataFrame) -> DataFrame:
    """``df``, its last columns made by a projection of their own. Many regular expressions in one fused stage make a method that the JVM does not compile,
    or that is too long; a projection with a function of functions (``let``) is not fused, and Spark splits its code."""
    name = df.columns[0]
    return df.withColumn(name, let(F.col(name), lambda x: x))


def normalize_text(c: Column) -> Column:
    """F-01: trimmed, white space collapsed, empty as null. Compatibility forms are left as they are: see ``unicode_text``."""
    return blank_to_null(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")))


@cache
def _unsettled() -> str:
    """A class of the signs that compatibility composition may change, alone or beside others, built from the Unicode tables of this Python."""
    import unicodedata

    made = {x for ch in map(chr, range(0x110000)) if not 0xD800 <= ord(ch) <= 0xDFFF and len(d := unicodedata.normalize("NFD", ch)) > 1 for x in d[1:]}  # what may join the sign before
    points = [i for i in range(0x80, 0x110000) if not 0xD800 <= i <= 0xDFFF and (unicodedata.combining(chr(i)) or chr(i) in made or unicodedata.normalize("NFKC", chr(i)) != chr(i))]
    ranges: list[list[int]] = []
    for i in points:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def unicode_text(c: Column) -> Column:
    """F-01: ``normalize_text`` after compatibility composition (NFKC). Texts without a sign that it may change, which one expression tells, never leave the JVM."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    text = c.cast("string")
    some = F.when(text.rlike(_unsettled()), text)
    return normalize_text(F.coalesce(composed(some), text))


def fold_accents(c: Column) -> Column:
    """Lower-case Latin letters without their marks, combining marks removed; JVM side."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{Mn}", "")


def text_key(c: Column) -> Column:
    """F-02: lower case without marks, only ``[a-z0-9 ,.-]`` and single spaces; null for null or blank, but may be ''."""
    folded = fold_accents(F.lower(normalize_text(c)))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s,.\-]", ""), r"\s+", " "))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def normalize_phone(c: Column) -> Column:
    """F-03: +34 before nine digits, 00 as +, eight characters at least."""
    raw = F.regexp_replace(c.cast("string"), r"[^0-9+]", "")
    raw = F.when(raw.startswith("00"), F.concat(F.lit("+"), F.substring(raw, 3, 1000))).otherwise(raw)
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(raw.startswith("+"), F.when(F.length(digits) >= 7, F.concat(F.lit("+"), digits))).when(F.length(digits) == 9, F.concat(F.lit("+34"), digits)).when(F.length(digits) >= 8, digits)


def flow_phone_key(c: Column) -> Column:
    """F-04: the last nine digits if they start with 34 and are eleven or more; nine at least."""
    d = digits_only(c)
    d = F.when(d.startswith("34") & (F.length(d) >= 11), F.right(d, F.lit(9))).otherwise(d)
    return F.when(F.length(d) >= 9, d)


def normalize_url(c: Column) -> Column:
    """F-05: https, lower host without www. and es., no query, fragment or closing slash."""
    u = F.trim(c)
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    has_host = rest.startswith("//")
    host = F.lower(F.when(has_host, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit("")))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^es\.", "")
    path = F.regexp_extract(F.when(has_host, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest), r"^([^?#]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(u != "", F.concat(F.lit("https://"), host, path))


def external_id(c: Column) -> Column:
    """F-06: the last path part after ``listing-``, else all after the last hyphen; without one, the whole URL."""
    last = F.element_at(F.split(F.regexp_replace(c, r"/+$", ""), "/"), -1)
    return F.when(c == "", None).when(last.startswith("listing-"), F.substring(last, 9, 1000)).otherwise(F.element_at(F.split(c, "-"), -1))


def portal_key(c: Column) -> Column:
    """F-07: first portal whose token occurs, else the text before a colon."""

    def of(k: Column) -> Column:
        out = F.when(F.coalesce(k, F.lit("")) == "", F.lit(None).cast("string"))
        for key, tokens, _ in PORTALS:
            out = out.when(k.rlike("|".join(tokens)), key)
        return out.otherwise(k)

    return let(text_key(c), of)


def portal_label(c: Column) -> Column:
    """F-07: the portal's name, else the text before a colon."""
    names = F.create_map(*[F.lit(x) for key, _, label in PORTALS for x in (key, label)])
    return let(normalize_text(c), lambda t: F.coalesce(F.try_element_at(names, portal_key(t)), blank_to_null(F.trim(F.substring_index(t, ":", 1))), t))


def property_type(c: Column) -> Column:
    """F-08: struct(family, detail); unknown types are of family other."""
    k = text_key(c)
    families = F.create_map(*[F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair])
    return F.when(F.coalesce(k, F.lit("")) != "", F.struct(F.coalesce(F.try_element_at(families, k), F.lit("other")).alias("family"), k.alias("detail")))


def address_fragment(c: Column, *, matcher: bool = True) -> Column:
    """F-17: the first four words of an address key without house numbers (``10b`` too) and street words. The matcher cuts words at marks as well."""
    k = text_key(c)
    k = F.regexp_replace(k, r"[,.\-]", " ") if matcher else k
    for dropped in (r"[0-9]+[a-z]?", "|".join(FRAGMENT_WORDS_MATCHER if matcher else FRAGMENT_WORDS)):
        k = F.regexp_replace(k, rf"\b({dropped})\b", " ")
    return blank_to_null(F.array_join(F.slice(F.filter(F.split(k, r"\s+"), lambda w: w != ""), 1, 4), " "))


def slug(c: Column) -> Column:
    """F-35: letters and digits of the key, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(text_key(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def excerpt(c: Column, limit: int = 180) -> Column:
    """F-35: at most ``limit`` characters, cut ones ending in three dots."""
    t = F.coalesce(normalize_text(c), F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))
