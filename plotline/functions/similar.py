"""Joins of similar strings by edit distance: prefix, length and count filters on letter pairs in one global order (F-23, for J-04 and J-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a gram. One insertion or deletion changes at most two grams of two letters, also where it joins or splits words.
GRAM = 2


def letter_pairs(text: Column) -> Column:
    """The pairs of letters of each word of a text, word ends included; repeated ones are numbered, so the array is a set. Order and number of blanks do not matter."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("^"), w, F.lit("$")).substr(i, F.lit(GRAM)))))
    number = lambda x, i: F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x))
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda x, i: F.concat(x, number(x, i).cast("string")))).otherwise(F.array(text))


def _changed(length: Column, least: float) -> Column:
    """How many of its grams a text of this length may lose on the way to one at the ratio ``least``: two for each letter that goes, one for each that comes."""
    slack = 1 - least / 100
    return F.floor(length * (4 * slack / (1 + slack)) + 1e-9)


def _rarest(df: DataFrame, name: str, parts: Column, often: DataFrame, most: Column) -> DataFrame:
    """name, parts, part: the ``most`` rarest of the parts of each distinct text, by the numbers in ``often`` (part, n)."""
    rows = df.where(F.col(name).isNotNull()).select(name).distinct().select(name, parts.alias("parts")).withColumn("part", F.explode("parts"))
    ranked = rows.join(often, "part", "left").withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "part")))
    return ranked.where(F.col("_k") <= most).select(name, "parts", "part")


def _counted(df: DataFrame, name: str, parts: Column) -> DataFrame:
    return df.where(F.col(name).isNotNull()).select(name).distinct().select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def edit_candidates(left: DataFrame, right: DataFrame, *, least: float) -> DataFrame:
    """key, other: pairs of the distinct keys of both sides (``left``: key, ``right``: other) among which are all whose ratio, with words in any order, is ``least`` or more.

    The ratio is 200 times the longest common subsequence over both lengths; ``least`` is above 67. Only the rarest grams of a key are shuffled: as many as
    edits may change and one more, in the order of their number in ``right``. What meets there must be of close lengths and share as many grams as edits leave.
    """
    if least <= 67:
        raise ValueError("below a ratio of 67 edits may leave no gram")
    often = _counted(right, "other", letter_pairs(F.col("other")))
    a = _rarest(left, "key", letter_pairs(F.col("key")), often, _changed(F.length("key"), least) + 1)
    b = _rarest(right, "other", letter_pairs(F.col("other")), often, _changed(F.length("other"), least) + 1).withColumnRenamed("parts", "parts_2")
    n, m = F.length("key"), F.length("other")
    edits = F.floor((n + m) * (1 - least / 100) + 1e-9)
    shared = F.size(F.array_intersect("parts", "parts_2"))
    needed = F.greatest(F.size("parts") - F.floor((3 * edits + n - m) / 2), F.size("parts_2") - F.floor((3 * edits + m - n) / 2))
    return a.join(b, "part").where((F.abs(n - m) <= edits) & (shared >= needed)).select("key", "other").distinct()


def edit_pairs(left: DataFrame, right: DataFrame, *, least: float) -> DataFrame:
    """key, other, ratio: the pairs of distinct keys at the ratio ``least`` or more. See ``edit_candidates``."""
    from plotline.functions.fuzzy import fuzzy_ratio

    scored = edit_candidates(left, right, least=least).withColumn("ratio", fuzzy_ratio(F.col("key"), F.col("other")))
    return scored.where(F.col("ratio") >= least)


def weighted_candidates(left: DataFrame, right: DataFrame, *, least: float) -> DataFrame:
    """key, other: pairs among which are all whose weighted ratio (F-24) is ``least`` or more; ``least`` is above 90, so ratios of parts alone never suffice.

    Two ways lead there: few edits, with words in any order, or one text's words standing nearly all in the other, which is at most half as long again. For
    the second, a text's rarest words (as many as may be missing, and one more) are looked for among all words of the other side.
    """
    if least <= 90:
        raise ValueError("at 90 and below, parts of texts count")
    words = lambda name: F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))
    slack = 1 - least / 95  # of the ratio of one text with the words that both have
    missing = lambda name: F.floor(F.length(name) * (slack / (1 - slack)) + 1e-9)
    often = _counted(right, "other", words("other"))

    def within(few: DataFrame, one: str, many: DataFrame, two: str) -> DataFrame:
        rare = _rarest(few, one, words(one), often, missing(one) + 1).select(one, "part")
        every = many.where(F.col(two).isNotNull()).select(two).distinct().withColumn("part", F.explode(words(two)))
        close = F.greatest(F.length(one), F.length(two)) < 1.5 * F.least(F.length(one), F.length(two))
        return rare.join(every, "part").where(close).select("key", "other")

    return edit_candidates(left, right, least=least).union(within(left, "key", right, "other")).union(within(right, "other", left, "key")).distinct()
