"""Operator 7, exact dedup by content-defined chunk recipes. DataFrame functions only.

A normalised text is cut where its content says so: after a letter pair of a fixed rare set and a space, no sooner than
``MIN_CHUNK`` characters after the last cut and no later than ``MAX_CHUNK``. Equal texts have equal cuts. The distinct chunks
move once, are grouped, and every 64-bit hash is verified to stand for one chunk; where it stands for several, the
chunks of that hash are numbered. The list of a document's chunk identifiers in order, its recipe, then equals another
document's exactly if the texts are equal, and only recipes move: eight bytes for some hundreds of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import ASCII_SPACE, durable, text_or_empty

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: A cut comes after one of these, as the last letter of a word, and a space.
CUT_AFTER = "[bcfgkmpvwz.,:;!?]"


def normalised(name: str = "text") -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(name), ASCII_SPACE, " ")


def chunks(text: Column, *, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of ``text`` in order; joined, they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?{CUT_AFTER} |.{{1,{most}}}"), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    """64 bits; fewer only to test collisions."""
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def _ambiguous(rows: DataFrame, bits: int) -> DataFrame:
    """h, chunk, number: the chunks of every hash that stands for more than one."""
    distinct = rows.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()
    several = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    number = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    return distinct.join(several, "h", "left_semi").select("h", "chunk", number.alias("number"))


def recipes(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, recipe (array of verified chunk identifiers) for every row of ``docs``.

    The verification runs here, once, over all distinct chunks. Only if a hash is ambiguous are identifiers extended by the
    chunk's number, for the documents that hold such a hash.
    """
    rows = docs.select("doc_id", normalised().alias("t")).select("doc_id", "t", chunks(F.col("t")).alias("chunks"))
    plain = rows.select(
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.struct(chunk_hash(c, bits).alias("h"), F.lit(0).alias("number"))).alias("recipe"),
    )
    ambiguous = durable(_ambiguous(rows, bits))
    if ambiguous.isEmpty():
        return plain.withColumn("recipe", F.transform("recipe", lambda x: x["h"]))
    held = rows.withColumn("text_sha256", F.sha2("t", 256))  # rows of one doc_id and one text are numbered alike
    key = ["doc_id", "text_sha256"]
    entries = held.select(*key, F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), bits))
    found = entries.join(ambiguous, ["h", "chunk"]).select(*key, "pos", "number").distinct()
    numbered = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "number"))).alias("numbers")).select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s"), "numbers")
    joined = held.join(numbered, held["doc_id"].eqNullSafe(numbered["_d"]) & (held["text_sha256"] == numbered["_s"]), "left")
    number = lambda i: F.coalesce(F.element_at(F.col("numbers"), i), F.lit(0))
    return joined.select("doc_id", "text_sha256", F.transform("chunks", lambda c, i: F.struct(chunk_hash(c, bits).alias("h"), number(i).alias("number"))).alias("recipe"))


def duplicates(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when they are identical after normalisation; the smallest doc_id of a group stays. Null texts are
    empty, and one group with empty ones. Rows of the same doc_id count apart in group_size and carry the same keep_id;
    all of them are kept if it is theirs. A null doc_id stays only where the whole group has none. An empty table gives no row.

    Groups are counted before they are shuffled, and joined back; a group that holds a third of all rows is one row on the
    counted side, and the other side of that join may be split.
    """
    found = durable(recipes(docs, bits=bits))
    groups = found.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """One row of ``docs`` for each text, the one of the smallest doc_id; columns as given, whatever their names.

    Rows without a doc_id come after all others. Of rows that repeat a text under one doc_id one stays; which one is open where
    their other columns differ. Null texts are empty. An empty table gives no row.

    Recipes decide; only then the rows are joined with what stays, by doc_id and digest of the text.
    """
    alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "n")
    same = recipes(docs, bits=bits).groupBy("recipe", "doc_id", "text_sha256").agg(F.count("*").alias("n"))
    stay = durable(same.groupBy("recipe").agg(F.min(alone).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.text_sha256").alias("digest"), F.col("x.n").alias("n")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(), 256).alias("digest"))
    left = lambda of: rows.join(of, rows["id"].eqNullSafe(of["id"]) & (rows["digest"] == of["digest"]), "left_semi")
    kept = left(stay)
    if not stay.where("n > 1").isEmpty():  # of these one row each, taken before they are shuffled
        once = left(stay.where("n > 1")).groupBy("id", "digest").agg(F.first("row").alias("row"))
        kept = left(stay.where("n = 1")).unionByName(once.select("row", "id", "digest"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
