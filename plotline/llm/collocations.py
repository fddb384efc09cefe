"""Operator 11, phrase collocations by an FM-index of each shard over word ids.

Documents of one language are gathered where they are read into shards of bounded size: a dictionary of its words and the text as ids. Words
that are rare in the whole corpus become separators, since no phrase that holds one can be frequent. Each shard is then indexed in both
directions (Burrows-Wheeler transforms of the ids and of the reversed ids, in the order of the next ``DEPTH - 1`` words, which is all that
intervals of that many words need), and phrases are enumerated by extending intervals, all of one length at once: to the left in one
transform, to the right in the other, with the interval in the other direction kept alongside. Counts are summed across shards by Spark.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import shuffle_partitions, text_or_empty, written

#: Words of a phrase at most, and words of a shard beyond which no further document joins it.
DEPTH, SHARD_WORDS = 3, 1 << 22
#: Rows of a transform whose intervals are extended at a time.
ROWS = 1 << 18
_UPPER, _LOWER, _MARKS = bytes(range(65, 91)), bytes(range(97, 123)), b".,;:!?\n\x0b\x0c\r"
#: ASCII capitals become small, marks between pieces a byte that UTF-8 never uses.
_FOLD = bytes.maketrans(_UPPER + _MARKS, _LOWER + b"\xff" * len(_MARKS))


class _Words(dict):
    """Ids of words by first appearance; 0 is the separator of pieces."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokens(text: str) -> list[bytes]:
    """Words and separators of a text, which ends with one."""
    return (text.encode("utf-8", "surrogatepass").translate(_FOLD) + b"\xff").replace(b"\xff", b" \xff ").split()


def shards(docs: DataFrame, *, size: int = SHARD_WORDS) -> DataFrame:
    """lang, shard, words, counts, ids: the documents of each partition and language (null: ``und``), ``size`` words or one document more in each shard.

    words and counts: the shard's dictionary; ids: the text as compressed 32-bit word numbers from 1, 0 between pieces. Null and empty texts have no words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[_Words, array]] = {}

        def packed(lang: str) -> pd.DataFrame:
            nonlocal made
            words, ids = held.pop(lang)
            made += 1
            counts = np.bincount(np.frombuffer(ids, np.uint32), minlength=len(words))[1:]
            names = [w.decode("utf-8", "surrogatepass") for w in list(words)[1:]]
            row = (lang, (task << 32) + made, names, counts.astype(np.int32), zstandard.compress(ids.tobytes(), 1))
            return pd.DataFrame([row], columns=["lang", "shard", "words", "counts", "ids"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if lang not in held:
                    held[lang] = _Words(), array("I")
                words, ids = held[lang]
                ids.extend(map(words.__getitem__, _tokens(text)))
                if len(ids) >= size:
                    yield packed(lang)
        for lang in list(held):
            yield packed(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "lang string, shard long, words array<string>, counts array<int>, ids binary")


class FMIndex:
    """Transforms of a text of ids in one direction: rows are suffixes in the order of their first ``depth`` ids.

    Within that order rows keep the text's order, so intervals of patterns of up to ``depth`` ids, and steps between them, are exact.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        wide, place = int(ids.max(initial=0)).bit_length(), n.bit_length()
        if depth * wide + place < 64:  # the next ids and the row in one number: sorted in place, no second array of the shard's length
            order = ids.astype(np.int64)
            for k in range(1, depth):
                order <<= wide
                order[: n - k] |= ids[k:]
            order <<= place
            for at in range(0, n, ROWS):
                order[at : at + ROWS] |= np.arange(at, min(at + ROWS, n))
            order.sort()
            order &= (1 << place) - 1
        else:
            order = np.lexsort([np.concatenate([ids[k:], np.zeros(min(k, n), ids.dtype)]) for k in reversed(range(depth))])
        order -= 1
        self.bwt = ids[order]
        del order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids))])  # where the rows that begin with each id start
        self._occurrences: np.ndarray | None = None

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The row to which ``symbols`` before each of ``rows`` lead: rows that begin with a smaller id, and its occurrences above."""
        n = len(self.bwt) + 1
        if self._occurrences is None:
            found = self.bwt.astype(np.int64)  # changed in place: only one array of the shard's length is added
            found *= n
            for at in range(0, n - 1, ROWS):
                found[at : at + ROWS] += np.arange(at, min(at + ROWS, n - 1))
            found.sort()
            self._occurrences = found
        return np.searchsorted(self._occurrences, symbols * n + rows)

    def extend(self, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-id extensions of the patterns with intervals [low, high) here and from ``other`` in the other direction.

        Returns for each: the number of its pattern, the id, the count, and its start in the other direction. Separators do not extend.
        """
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner <<= 32
        owner |= self.bwt[rows]
        del rows
        found, count = np.unique(owner, return_counts=True)
        owner, symbol = found >> 32, found & 0xFFFFFFFF
        before = np.cumsum(count) - count  # rows of all patterns before, and of smaller ids of the same
        at = other[owner] + before - (np.cumsum(size) - size)[owner]
        keep = symbol > 0
        return owner[keep], symbol[keep], count[keep], at[keep]


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Intervals of these sizes by about ``ROWS`` rows."""
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ROWS, "right")))
        yield slice(start, stop)
        start = stop


def enumerate_phrases(ids: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct phrases of 2 to ``depth`` words of ``ids`` (0 separates), in arrays of one length each, and their counts."""
    if not len(ids) or ids.max() == 0 or depth < 2:
        return
    ids = np.concatenate([ids, [0]]).astype(np.int32)  # the id before the first is the separator
    forward, backward = FMIndex(ids, max(depth - 1, 1)), FMIndex(ids[::-1], max(depth - 1, 1))
    del ids

    def to_the_right(phrases: np.ndarray, low: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield phrases, count
        if phrases.shape[1] < depth:
            for some in _slices(count):
                owner, symbol, more, _ = backward.extend(low[some], (low + count)[some], low[some])
                at = backward.rank(symbol, low[some][owner]) if phrases.shape[1] + 1 < depth else symbol
                yield from to_the_right(np.concatenate([phrases[some][owner], symbol[:, None]], 1), at, more)

    words = np.arange(1, len(forward.first) - 1)
    words = words[forward.first[words + 1] > forward.first[words]]
    low, high = forward.first[words], forward.first[words + 1]
    for some in _slices(high - low):
        owner, symbol, count, at = forward.extend(low[some], high[some], backward.first[words[some]])  # one word to the left
        yield from to_the_right(np.stack([symbol, words[some][owner]], 1), at, count)


def _phrase_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phrases of one shard (ids, at and gid: the corpus numbers of its frequent words): g1, g2, g3 (-1: none) and their count."""
    import zstandard

    for pdf in batches:
        for packed, at, gid in zip(pdf["ids"], pdf["at"], pdf["gid"], strict=True):
            order = np.argsort(at)
            local, gid = at[order] + 1, gid[order]

            def dense_ids(packed=packed, local=local) -> np.ndarray:
                ids = np.frombuffer(zstandard.decompress(packed), np.uint32)
                dense = np.zeros(int(max(ids.max(initial=0), local[-1])) + 1, np.int32)
                dense[local] = np.arange(1, len(local) + 1)
                ids = dense[ids]
                kept = ids > 0
                kept[1:] |= ids[:-1] > 0  # one separator after another is none
                kept[:1] = True
                return ids[kept]

            for phrases, count in enumerate_phrases(dense_ids()):  # not held here: the indexes take its place
                part = gid[phrases - 1]
                columns = {f"g{k + 1}": part[:, k] if k < part.shape[1] else np.full(len(part), -1) for k in range(DEPTH)}
                yield pd.DataFrame(columns | {"c": count})


def frequent_phrases(docs: DataFrame, *, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, gid, word, f, n: all words of the language), and the phrases of two and of three words by those numbers with their counts a.

    All of them stand ``least`` times or more in their language; counts are exact. Each is a written table.
    """
    parts = written(shards(docs), "phrase-shards")
    seen = parts.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("lang", "shard", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    totals = parts.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = seen.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    words = written(words.join(totals, "lang").withColumn("gid", F.monotonically_increasing_id()), "phrase-words")
    local = seen.select("lang", "shard", "at", "word").join(words.select("lang", "word", "gid"), ["lang", "word"])
    local = local.groupBy("shard").agg(F.collect_list(F.struct("at", "gid")).alias("x")).select("shard", "x.at", "x.gid")  # at most the words of one shard
    rows = local.join(parts.select("shard", "ids"), "shard").groupBy("shard").applyInPandas(_phrase_rows, "g1 long, g2 long, g3 long, c long")
    counts = written(rows.groupBy("g1", "g2", "g3").agg(F.sum("c").alias("a")).where(F.col("a") >= least), "phrase-counts")
    return words, counts.where("g3 = -1").drop("g3"), counts.where("g3 >= 0")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda x: x.cast("decimal(18,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, *, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two and three words that stand ``least`` times or more.

    Words are what white space and marks leave; capitals A to Z become small. Of the cuts of a phrase the one of the lowest score counts, of equal ones the
    first. Phrases are dropped that lie within a longer one with ``share`` hundredths of their count. Languages (null: ``und``) do not meet. Ties of the score go
    to the more frequent phrase, then to the first in the order of UTF-8. Null and empty texts have no phrase; repeated rows count as often as they stand;
    an empty table gives no row. Other columns of ``docs`` are not read.
    """
    words, pairs, triples = frequent_phrases(docs, least=least)
    word = lambda k: words.select(F.col("gid").alias(f"g{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    longer = triples.select("a", F.explode(F.array(F.struct("g1", "g2"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2")))).alias("x"))
    longer = longer.groupBy("x.g1", "x.g2").agg(F.max("a").alias("most"))
    first = words.select(F.col("gid").alias("g1"), "lang", "n", F.col("word").alias("w1"), F.col("f").alias("f1"))
    two = pairs.join(longer, ["g1", "g2"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * share, F.lit(True))).join(first, "g1").join(word(2), "g2")
    two = two.select("lang", "n", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(pairs.withColumnRenamed("a", "f12"), ["g1", "g2"]).join(pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("f23")), ["g2", "g3"])
    three = three.join(first, "g1").join(word(2), "g2").join(word(3), "g3")
    cut = lambda k, left, right: F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.withColumn("cut", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")))
    three = three.select("lang", "n", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = two.union(three).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession))))
    best = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
