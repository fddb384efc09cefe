"""Operator 2, token-id output: fixed-width bit packing.

File format: Parquet, one row for each block. A block holds whole documents, in ascending (doc_id, text) order, at
least ``block_ids`` ids but for the last of a shard. Columns:

- shard, block: place in the order of the file; shards are ranges of doc_id.
- bits: width of an id, the fewest that hold the vocabulary.
- n_ids, payload: the ids one after another, most significant bit first, zero-filled to a whole byte.
- first: number of ids of the shard before this block (the block offset).
- doc_ids, doc_starts: documents of the block and the place of their first id in it.

``totals`` gives the ids before each shard, so a position in the whole corpus leads to one block and one bit offset.
Blocks are self-contained: numpy unpacks any range of a block without reading the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm import tokens
from plotline.llm.common import id_as_text, shared_path, shuffle_partitions, text_or_empty

BLOCK_IDS = 1 << 16
SCHEMA = "shard int, block int, bits int, n_ids long, first long, doc_ids array<long>, doc_starts array<long>, payload binary"


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as a row of bits-wide big-endian fields."""
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), BLOCK_IDS):  # a multiple of 8 fields ends on a whole byte
        fields = np.unpackbits(ids[i : i + BLOCK_IDS].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(fields[:, 32 - bits :]).tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, without touching what lies outside them."""
    if stop <= start:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        n = bits // 8
        return np.frombuffer(payload, f">u{n}", stop - start, start * n).astype("<u4")
    out = []
    for i in range(start, stop, BLOCK_IDS):
        n = min(BLOCK_IDS, stop - i)
        low = i * bits // 8
        raw = np.unpackbits(np.frombuffer(payload, np.uint8, (i + n) * bits // 8 + ((i + n) * bits % 8 > 0) - low, low))
        fields = np.zeros((n, 32), np.uint8)
        fields[:, 32 - bits :] = raw[i * bits - 8 * low :][: n * bits].reshape(n, bits)
        out.append(np.packbits(fields, axis=1).view(">u4").ravel().astype("<u4"))
    return np.concatenate(out)


def write(docs: DataFrame, path: str, *, tokenizer_path: str | None = None, cut=tokens.word_chunks, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the ids in ascending doc_id order to ``path``.

    One range shuffle of the texts; each shard is encoded as a stream and its blocks are committed by Spark's writer, so a
    lost task is simply run again. Rows of the same doc_id are kept, in the order of their texts. Null doc_ids come first.
    """
    spark = docs.sparkSession
    source = tokenizer_path or tokens.public_path("word_bpe_49k.json")
    bits = width(tokens.vocabulary_size(source))
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(source, cut)
        shard, block, first = None, 0, 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, block, first
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            starts = np.cumsum([0, *(len(x) // 4 for _, x in held[:-1])])
            row = pd.DataFrame({"shard": [shard], "block": [block], "bits": [bits], "n_ids": [len(ids)], "first": [first], "doc_ids": [[d for d, _ in held]], "doc_starts": [starts.tolist()], "payload": [pack(ids, bits)]})
            held, size, block, first = [], 0, block + 1, first + len(ids)
            return row

        for pdf in batches:
            shard = int(pdf["shard"].iloc[0]) if len(pdf) else shard
            texts = pdf["text"].tolist()
            ids = [None if d is None else int(d) for d in pdf["doc_id"].tolist()]
            for a, b in tokens.slices([len(t) for t in texts]):
                for d, x in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    held.append((d, x + end))
                    size += len(x) // 4 + 1
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()

    id_as_text(ordered, "text", F.spark_partition_id().alias("shard")).mapInPandas(run, SCHEMA).write.parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """shard, before: ids of all shards before it. One row for each shard, few enough for one task."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (packed as little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = unpack(r.payload, r.bits, 0, r.n_ids)
                starts = np.asarray(r.doc_starts, dtype=np.int64)
                stops = np.append(starts[1:], r.n_ids)
                yield pd.DataFrame({"shard": r.shard, "doc_id": list(r.doc_ids), "at": r.first + starts, "n_tokens": stops - starts, "ids": [ids[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]})

    blocks = spark.read.schema(SCHEMA).parquet(path)
    named = blocks.withColumn("doc_ids", F.transform("doc_ids", lambda d: d.cast("string")))
    rows = named.mapInPandas(run, "shard int, doc_id string, at long, n_tokens long, ids binary")
    # the number of shards is that of the writer's partitions
    placed = rows.join(F.broadcast(totals(spark, path)), "shard")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids at places start to stop of the whole corpus; only the blocks that hold them are read."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    at = F.col("before") + F.col("first")
    found = (
        blocks.join(F.broadcast(totals(spark, path)), "shard")
        .where((at < stop) & (at + F.col("n_ids") > start))
        .select(at.alias("at"), "bits", "n_ids", "payload")
        .orderBy("at")
    )
    parts = [unpack(bytes(r["payload"]), r["bits"], max(0, start - r["at"]), min(r["n_ids"], stop - r["at"])) for r in found.toLocalIterator()]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new file in the shared folder, read it back: doc_id, start, n_tokens, ids_crc32.

    An empty table writes no block and gives no row.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "token-blocks")
    write(docs, path, **options)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
