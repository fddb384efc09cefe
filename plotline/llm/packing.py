"""Operator 4, best-fit packing by large-item matching.

Only lengths decide where a piece goes, and a length is at most the capacity. So the plan is made on the histogram of
lengths (at most ``capacity`` rows, whatever the corpus): lengths above a third of the capacity fit at most twice in a
bin and are matched greedily, the longest first, each with the longest that still fits; the shorter ones then go, the
longest first, where the gap left is the smallest. The plan is a list of runs, each saying into which bins a range of
the pieces of one length goes. Spark numbers the pieces of each length and joins them with the runs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm import tokens
from plotline.llm.common import durable, id_as_text, id_restored, text_or_empty

CAPACITY = 2048


class Run(NamedTuple):
    """Pieces ``first`` to ``first + n`` of one length: ``each`` to a bin, from bin ``bin`` on, from place ``offset`` on."""

    length: int
    first: int
    n: int
    bin: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of bins. ``counts``: pieces of each length from 1 to capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    runs: list[Run] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> (first bin, number of bins)

    def put(length: int, n: int, at: int, each: int, offset: int) -> None:
        runs.append(Run(length, taken[length], n, at, each, offset))
        taken[length] += n
        left[length] -= n

    def room(space: int, at: int, n: int) -> None:
        if space > 0 and n > 0:
            gaps.setdefault(space, []).append((at, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        if b == 0:
            n, space = left[a], capacity - a
        elif b == a:
            n, space = max(1, left[a] // 2), capacity - 2 * a if left[a] > 1 else capacity - a
        else:
            n, space = min(left[a], left[b]), capacity - a - b
        pair = b and (b != a or left[a] > 1)
        put(a, n, bins, 1, 0)
        if pair:
            put(b, n, bins, 1, a)
        room(space, bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[s]:
            spaces = sorted(x for x in gaps if x >= s)
            if spaces:
                space = spaces[0]
                at, n = gaps[space].pop()
                if not gaps[space]:
                    del gaps[space]
            else:
                space, at, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            each = space // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, at, each, capacity - space)
                room(space - each * s, at, full)
            rest = left[s] if full < n else 0
            if rest:  # fewer than ``each``: they share the next bin
                put(s, rest, at + full, rest, capacity - space)
                room(space - rest * s, at + full, 1)
                full += 1
            room(space, at + full, n - full)
    return runs, bins


def pieces(docs: DataFrame, *, tokenizer_path: str | None = None, cut=tokens.space_chunks, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: one pass over the whole texts, no shuffle.

    A document is its ids and ``end_id``. Longer ones are cut so that all pieces but the first are full.
    """
    source = tokenizer_path or tokens.public_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        encode = tokens.encoder(source, cut)
        for pdf in batches:
            texts, docs_, rows = pdf["text"].tolist(), pdf["doc_id"].tolist(), []
            for a, b in tokens.slices([len(t) for t in texts]):
                for d, x in zip(docs_[a:b], encode(texts[a:b]), strict=True):
                    x += end
                    n = len(x) // 4
                    at = 0
                    for piece in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if piece == 0 else capacity
                        rows.append((d, piece, at, size, zlib.crc32(x[4 * at : 4 * (at + size)])))
                        at += size
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = id_as_text(docs, text_or_empty().alias("text")).mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return id_restored(found, docs)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and its offset there; sequences hold at most ``capacity`` tokens.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one token long. Rows of
    the same doc_id are packed apart. An empty table gives no row. Other columns of ``docs`` are left out.

    Texts are encoded once; the pieces (some tens of bytes each) go to the checkpoint folder. They are numbered by
    length within each part of that table, and the counts of the parts before are added, so that a length that many
    pieces share never meets in one task.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, capacity=capacity, **options).withColumn("part", F.spark_partition_id()))
    parts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    table = spark.createDataFrame([tuple(r) for r in runs], "length long, first long, n long, bin long, each long, base_offset long")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "part"]).withColumn("k", F.col("k") + F.col("base"))
    # runs grow with the capacity, not with the corpus
    placed = numbered.join(F.broadcast(table.withColumnRenamed("length", "run_length")), (F.col("length") == F.col("run_length")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("n")))
    i = F.col("k") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base_offset") + F.pmod(i, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
