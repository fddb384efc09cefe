"""Fuzzy ratios (F-23): indel similarity by bit-parallel longest common subsequence, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plotline.functions.text import address_fragment


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-integer step for each letter of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common letter."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def _windows(a: str, b: str) -> list[tuple[float, str]]:
    """Windows of ``b`` as long as ``a``, those cut at both ends included, each with the ratio that its letters admit at most."""
    n, rest = len(a), {}
    for ch in a:
        rest[ch] = rest.get(ch, 0) + 1
    common, out = 0, []
    for i in range(1 - n, len(b)):
        if i + n - 1 < len(b):
            ch = b[i + n - 1]
            rest[ch] = rest.get(ch, 0) - 1
            common += rest[ch] >= 0
        if i > 0:
            ch = b[i - 1]
            common -= rest[ch] >= 0
            rest[ch] += 1
        span = b[max(0, i) : i + n]
        out.append((200.0 * common / (n + len(span)), span))
    return out


def best_window_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, windows cut at both ends included; equal lengths try both directions."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    tries = [(most, a, span) for most, span in _windows(a, b)] + ([(most, b, span) for most, span in _windows(b, a)] if len(a) == len(b) else [])
    best = 0.0
    for most, x, span in sorted(tries, reverse=True):
        if most <= best:
            break
        best = max(best, indel_ratio(x, span))
    return best


def _pairs(f, x: pd.Series, y: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for a, b in zip(x, y, strict=True):
        if a is None or b is None or a != a or b != b:
            out.append(0.0)
            continue
        if (a, b) not in known:
            known[a, b] = f(a, b)
        out.append(known[a, b])
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(indel_ratio, a, b)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(best_window_ratio, a, b)


def address_similarity(a: Column, b: Column) -> Column:
    """The better of both ratios of two addresses' fragments; 0 without one."""
    x, y = address_fragment(a), address_fragment(b)
    return F.greatest(fuzzy_ratio(x, y), partial_ratio(x, y))


def _token_ratios(a: str, b: str) -> tuple[float, float]:
    """Ratios that do not mind the order of words: whole (sorted, and by what is common), and of parts."""
    x, y = a.split(), b.split()
    common = sorted(set(x) & set(y))
    more_x, more_y = " ".join(sorted(set(x) - set(common))), " ".join(sorted(set(y) - set(common)))
    ordered = " ".join(sorted(x)), " ".join(sorted(y))
    whole = indel_ratio(*ordered)
    if common:
        base = " ".join(common)
        both = [f"{base} {m}".strip() for m in (more_x, more_y)]
        whole = 100.0 if not (more_x and more_y) else max(whole, indel_ratio(*both), *(indel_ratio(base, m) for m in both))
    part = 100.0 if common else max(best_window_ratio(*ordered), best_window_ratio(more_x, more_y))
    return whole, part


def weighted(a: str, b: str) -> float:
    """The best of ratios of whole texts, parts and words, parts counting less the more the lengths differ."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    whole, part = _token_ratios(a, b)
    if size < 1.5:
        return max(indel_ratio(a, b), 0.95 * whole)
    scale = 0.9 if size < 8 else 0.6
    return max(indel_ratio(a, b), scale * best_window_ratio(a, b), 0.95 * scale * part)


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-24: see ``weighted``."""
    return _pairs(weighted, a, b)


def best_keys(keys: DataFrame, choices: DataFrame, *, least: float = 92.0) -> DataFrame:
    """F-24: key, choice, score: of the distinct ``keys`` (key) the best of ``choices`` (choice, place) at ``least`` or more; ties: the first place.

    Ratios are computed only on the pairs that ``weighted_candidates`` leaves; none at ``least`` (above 90) is missed.
    """
    from plotline.functions.similar import weighted_candidates

    places = choices.where("choice is not null").groupBy("choice").agg(F.min("place").alias("place"))
    pairs = weighted_candidates(keys, choices.withColumnRenamed("choice", "other"), least=least).withColumnRenamed("other", "choice")
    scored = pairs.withColumn("score", weighted_ratio(F.col("key"), F.col("choice"))).where(F.col("score") >= least).join(places, "choice")
    return scored.groupBy("key").agg(F.max(F.struct("score", -F.col("place"), "choice")).alias("b")).select("key", "b.choice", "b.score")
