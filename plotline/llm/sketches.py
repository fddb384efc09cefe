"""Operator 5, document fingerprints: threshold-scaled sketches. DataFrame functions only.

Of the 64-bit hashes of a text's five-word shingles a sketch retains every one below a fixed fraction of the range. Sketches of
parts merge by union, and the share of one sketch found in another estimates containment without bias from size, so a
paragraph is recognised in a book. The fraction is one in ``SCALE``, a parameter of the whole table: short and long texts
are retained by one rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import shuffle_partitions, text_or_empty

SHINGLE = 5
#: One hash in so many is retained.
SCALE = 4
_LOWEST = -(1 << 63)


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the shingles of lower-case words; of a text with fewer words, one of all its words; of none, none."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _hashes(words, shingle)


def _hashes(words: Column, shingle: int) -> Column:
    n = F.size(words)
    return (
        F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)])))
        .when(n > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """struct(words, hashes): whether the text has a shingle at all, and the retained hashes, ascending and distinct."""
    kept = F.filter(hashes, lambda h: h < F.lit(_LOWEST + (1 << 64) // scale)) if scale > 1 else hashes
    return F.struct((F.size(hashes) > 0).alias("words"), F.array_sort(F.array_distinct(kept)).alias("hashes"))


def with_sketch(df: DataFrame, text: str, out: str, *, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of column ``text`` as column ``out``."""
    return (
        df.withColumn("_words", F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .withColumn("_hashes", _hashes(F.col("_words"), shingle))
        .withColumn(out, sketch(F.col("_hashes"), scale))
        .drop("_words", "_hashes")
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.struct((a["words"] | b["words"]).alias("words"), F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has; 1 for two texts without words, 0 for one.

    Null, no estimate, where nothing is retained of a text that has words.
    """
    least = F.least(F.size(a["hashes"]), F.size(b["hashes"]))
    return F.when(~a["words"] & ~b["words"], 1.0).when(~a["words"] | ~b["words"], 0.0).when(least > 0, F.size(F.array_intersect(a["hashes"], b["hashes"])) / least)


def as_text(a: Column) -> Column:
    """A sketch as one string of sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], *, by: str = "doc_id", tie: str = "text") -> DataFrame:
    """``docs`` with a struct column ``next``: ``columns`` of the row that follows in ascending ``by``; after the last, the first.

    Rows are dealt into ranges of ``by`` at its approximate quantiles, and the first row of each range goes to the range before
    it as well, so no row waits for a global order. One shuffle of the rows. Ties of ``by`` go by ``tie``; null comes first.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_key", F.coalesce(F.col(by).cast("long"), F.lit(_LOWEST)))
    parts = 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    # two steps: the block of quantiles, then the place in it
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("_key")))

    if len(cuts) > 1:
        heads = F.array(*[F.lit(b[0]) for b in blocks])
        tails = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
        at = F.greatest(below(heads), F.lit(1))
        shard = (at - 1) * width + below(F.element_at(tails, at))
    else:
        shard = F.lit(0)
    rows = rows.withColumn("_shard", shard)
    # one row for each range
    firsts = [tuple(r) for r in rows.groupBy("_shard").agg(F.min("_key").alias("k")).orderBy("_shard").collect()]
    also = [(k, firsts[i - 1][0], int(i == 0)) for i, (_, k) in enumerate(firsts)]
    ghosts = spark.createDataFrame(also, "_key long, _to int, _wrap int")
    own = F.struct(F.col("_shard").alias("to"), F.lit(0).alias("wrap"), F.lit(0).alias("ghost"))
    more = F.struct(F.col("_to").alias("to"), F.col("_wrap").alias("wrap"), F.lit(1).alias("ghost"))
    dealt = rows.join(F.broadcast(ghosts), "_key", "left").withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, more))))
    dealt = dealt.withColumns({"_to": F.col("_at.to"), "_wrap": F.col("_at.wrap"), "_ghost": F.col("_at.ghost")}).drop("_at", "_shard")
    order = Window.partitionBy("_to").orderBy("_wrap", "_key", tie)
    found = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_ghost = 0")
    return found.drop("_key", "_to", "_wrap", "_ghost")


def edited_pairs(docs: DataFrame, *, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """For each row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document,
    ascending doc_id. Likeness is containment, 0 where there is no estimate. Null texts are empty; a text of which nothing is retained has the fingerprint ''. Rows of the same
    doc_id are neighbours in the order of their texts. An empty table gives no row.
    """
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    paired = with_next(docs.select("doc_id", text_or_empty().alias("text")), ["text"])
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "text", F.col("next.text").alias("next_text"),
        F.concat(F.substring("text", F.lit(1), n - k), F.substring("next.text", F.lit(1), k)).alias("edited"),
    )
    both = edited  # sketches are made where they are compared: texts alone are shuffled
    for name, out in (("text", "sketch"), ("next_text", "next_sketch")):
        both = with_sketch(both, name, out, shingle=shingle, scale=scale)
    both = both.drop("text", "next_text")
    both = with_sketch(both, "edited", "edited_sketch", shingle=shingle, scale=scale)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.coalesce(containment(F.col("sketch"), F.col("edited_sketch")), F.lit(0.0)).alias("near_edited"),
        F.coalesce(containment(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
    )
