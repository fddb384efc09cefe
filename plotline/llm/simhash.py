"""Operator 9, SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within r/2 bits of each. Every distinct fingerprint
therefore emits all its variants within half the radius; the variants are shuffled, fingerprints that meet are verified and
linked, and connected components are found by alternating large-star and small-star steps over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import durable, id_as_text, id_restored, text_or_empty, written

SEED, BITS, RADIUS, SHINGLE = 42, 64, 2, 3


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer: lower-case words (ASCII), shingles with their repeats."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [h(joined, SEED)]
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every whole text of ``docs``; null and wordless texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id"]].copy()
            out["fp"] = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.int64)
            yield out

    return id_restored(id_as_text(docs, text_or_empty().alias("text")).mapInPandas(run, "doc_id string, fp long"), docs)


@lru_cache(maxsize=8)
def masks(radius: int, bits: int = BITS) -> list[int]:
    """Every signed 64-bit mask of at most ``radius`` bits."""
    found = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """a, b: links between distinct fingerprints of ``fps`` (column fp) that differ in at most ``radius`` bits.

    Not all pairs: those that meet in a variant are each linked with the next of them, which joins the same fingerprints.
    At most 65 distinct fingerprints are within one bit of a variant, so nothing that meets there grows with the corpus.
    Each link is verified. ``radius`` is even.
    """
    if radius % 2:
        raise ValueError("radius must be even: each side emits half of it")
    ball = F.array(*[F.lit(m) for m in masks(radius // 2)])
    emitted = fps.select("fp").distinct().select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = emitted.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of ``edges`` (a, b).

    Alternating small-star and large-star: each node hands its smaller neighbours to the smallest of them, which drops most
    of the links in a dense group, then its larger neighbours, until nothing changes. Every round is checkpointed; a star's centre aggregates its minimum
    before it is shuffled, and no neighbour list is gathered.
    """

    def symmetric(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")

    def large(e: DataFrame) -> DataFrame:
        both = symmetric(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a")
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = state(now)
    for _ in range(rounds):
        now = durable(large(small(now)))
        if (found := state(now)) == was:
            break
        was = found
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``: the smallest doc_id reachable by links, itself included.

    Copies share one fingerprint and are one node. Null and wordless texts have fingerprint 0, linked like any other. Rows of
    the same doc_id each get a row; a doc_id with several texts does not join their components. An empty table gives no row.
    """
    fps = durable(fingerprints(docs, shingle=shingle))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(fps, radius=radius)
    parts = components(edges)
    labelled = first.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = labelled.join(lowest, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


#: For texts that are similar, not nearly equal: fingerprints of so many bits, of the distinct word pairs, dealt into tables.
WIDE_BITS, PAIR_SHINGLE = 192, 2
#: Slots that the texts of candidate pairs are hashed into: the table of used slots, which is broadcast, never has more rows.
SLOTS = 1 << 22
#: Texts are similar whose sets of so many words have a Jaccard similarity of NEAR / OF or more.
GRAM, NEAR, OF = 5, 4, 5
#: One text in SAMPLE is asked which shingles are common, at more than COMMON heads of these, HEAVY of them at most; it sets their order, not the results.
SAMPLE, COMMON, HEAVY = 8, 12, 1 << 16
#: A row of a shingle carries so many shared shingles before it in its head, so that a pair that shares many is not listed at each.
AHEAD = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def table_bits(rows: int) -> int:
    """Width of a table: the narrowest at which a variant of one fingerprint meets less than one other by chance among ``rows``."""
    return next((w for w in (32, 48) if rows * (w + 1) <= 1 << w), 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's lower-case words, in order."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.array([h(w, SEED) for w in text.encode().lower().split()], np.uint64)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending: the words' hashes, combined and mixed. Of fewer words one of all."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    mixed = np.full(n, len(words[:size]), np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ words[k : k + n]) * _ODD[0]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _gram_hashes(text: str) -> np.ndarray:
    return _shingles(_word_hashes(text), GRAM)


def _wide(pairs: np.ndarray) -> np.ndarray:
    """192 SimHash bits of distinct shingles' hashes, as three signed 64-bit integers."""
    out = np.zeros(3, np.int64)
    for k, odd in enumerate(_ODD):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(pairs), 1 << 16):
            part = _mixed(pairs[i : i + (1 << 16)] * odd)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(pairs)).view("<i8")[0]
    return out


def _key(hashes: np.ndarray) -> int:
    import xxhash

    k = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return k - (1 << 64) if k >> 63 else k


def _parity(hashes: np.ndarray) -> np.ndarray:
    """1024 bits as signed integers: whether an odd number of the shingles falls on each. Two texts differ in at least as many shingles as bits.

    So they do in the 256 bits of ``_folded``, which are fewer to carry and tell less of long texts.
    """
    return np.packbits(np.bincount((hashes >> np.uint64(8)).astype(np.int64) & 1023, minlength=1024) & 1).view("<i8")


#: The columns of ``_parity``, and of its 256 bits.
PARITY, FOLDED = [f"p{i}" for i in range(16)], [f"q{i}" for i in range(4)]


def _folded() -> list[Column]:
    """Parities of 256 bits from those of 1024: each bit of four together."""
    return [reduce(Column.bitwiseXOR, [F.col(x) for x in PARITY[i :: len(FOLDED)]]).alias(q) for i, q in enumerate(FOLDED)]


def _parities_admit(columns: list[str]) -> Column:
    """Whether the parities of both texts (the other's end in _2) let them differ in a ninth of both sizes at most, as texts at 0.8 do."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_2"))) for x in columns), F.lit(0))
    return differ * (NEAR + OF) <= (F.col("size") + F.col("size_2")) * (OF - NEAR)


def _head(n: int) -> int:
    """How many shingles of n, the rarest, a text must show so that it shares one with every text at 0.8 or more."""
    return n - -(-n * NEAR // OF) + 1 if n else 0


def common_grams(docs: DataFrame) -> dict[int, int]:
    """The ``HEAVY`` shingles, or fewer, that most heads of one text in ``SAMPLE`` have, and how many; they go last in the order of all shingles, the others by hash.

    Any one order finds the same pairs, so the bound on what the driver gathers and tasks are sent changes no result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [h[: _head(len(h))] for h in map(_gram_hashes, pdf["text"])]
            yield pd.DataFrame({"gram": np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)})

    sample = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInPandas(run, "gram long")
    rows = sample.groupBy("gram").count().where(F.col("count") > COMMON).orderBy(F.desc("count"), "gram").limit(HEAVY).collect()
    return {r["gram"] % (1 << 64): r["count"] for r in rows}


PRINT = f"doc_id string, digest long, key long, f0 long, f1 long, f2 long, {', '.join(f'{p} long' for p in PARITY)}, size int, head array<long>"


def prints(docs: DataFrame, common: dict[int, int]) -> DataFrame:
    """One row for each row of ``docs``, from one pass over the whole texts: doc_id, digest of the text, and

    key (texts of the same five-word shingles have the same), f0 to f2 (192 SimHash bits of its word pairs), p0 to p15 (``_parity``),
    size (number of shingles), head (its ``_head`` rarest shingles, in an order in which those of ``common`` come last).
    """
    grams = np.array(sorted(common), np.uint64)
    counts = np.array([common[g] for g in sorted(common)], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                rows = []
                for text in part["text"]:
                    words = _word_hashes(text)
                    hashes = _shingles(words, GRAM)
                    head, k = hashes, _head(len(hashes))
                    if len(grams) and k:
                        i = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
                        head = hashes[np.argsort(np.where(grams[i] == hashes, counts[i], 0), kind="stable")]
                    rows.append((_key(hashes), *_wide(_shingles(words, PAIR_SHINGLE)), *_parity(hashes), len(hashes), head[:k].view(np.int64)))
                out = pd.DataFrame(rows, columns=["key", "f0", "f1", "f2", *PARITY, "size", "head"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                out.insert(1, "digest", part["digest"].to_numpy())
                yield out

    text = text_or_empty()
    return id_restored(id_as_text(docs, text.alias("text"), F.xxhash64(text).alias("digest")).mapInPandas(run, PRINT), docs)


def _can_be_near(pos, size, pos2, size2):
    """Whether texts whose first common shingle has these places can share enough: 0.8 of the union is 4/9 of both sizes."""
    return (F.least(size - pos, size2 - pos2) * (NEAR + OF) >= (size + size2) * NEAR) & (F.least(size, size2) * OF >= F.greatest(size, size2) * NEAR)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose ``texts`` (key, text) have a five-word similarity of 0.8 or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = lru_cache(maxsize=64)(_gram_hashes)
        for pdf in batches:
            near = []
            for x, y in zip(pdf["s"], pdf["t"], strict=True):
                x, y = grams(x), grams(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two ascending runs
                near.append((NEAR + OF) * int((both[1:] == both[:-1]).sum()) >= NEAR * len(both))
            yield pdf[["a", "b"]][near]

    of = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("t")), "b")
    return of.select("a", "b", "s", "t").mapInPandas(run, "a long, b long")


def simhash_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """a, b: keys of ``nodes`` (key, f0, f1, f2) that meet in a variant of a table of ``bits`` bits.

    Of those that meet, each is paired with the first and with the one before it.
    """
    if WIDE_BITS % bits or bits not in (32, 48, 64):
        raise ValueError("tables of 32, 48 or 64 bits")
    words = F.array("f0", "f1", "f2")

    def table(i: int):
        low, word = i * bits % 64, i * bits // 64
        part = F.shiftrightunsigned(words[word], low)
        if low + bits > 64:
            part = part.bitwiseOR(F.shiftleft(words[word + 1], 64 - low))
        return F.struct(F.lit(i).alias("table"), (part.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else part).alias("bits"))

    ball = F.array(*[F.lit(m).cast("long") for m in masks(1, bits)])
    emitted = nodes.select("key", F.explode(F.array(*[table(i) for i in range(WIDE_BITS // bits)])).alias("t"))
    emitted = emitted.select("key", "t.table", F.explode(F.transform(ball, lambda m: F.col("t.bits").bitwiseXOR(m))).alias("variant"))
    bucket = Window.partitionBy("table", "variant").orderBy("key")
    met = emitted.select("key", F.lag("key").over(bucket).alias("before"), F.first("key").over(bucket).alias("first")).where("before is not null")
    pairs = met.select("key", F.explode(F.array_distinct(F.array("before", "first"))).alias("other")).where("key <> other")
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def met_once(member: DataFrame) -> DataFrame:
    """Pairs of rows of ``member`` (gram, key, part, pos, size, q0 to q3, ahead) of one gram and unlike parts that sizes, places and parities admit.

    Two texts that share one shingle of their heads often share dozens. A pair is left out at a shingle where one of the last ``AHEAD`` shingles before it (ahead)
    is in the other's too: there it met before, at places that admit no less. At their first common shingle there is none, so no pair is lost.
    """
    other = member.select("gram", *[F.col(x).alias(f"{x}_2") for x in ("part", "key", "pos", "size", "ahead", *FOLDED)])
    admits = _can_be_near(F.col("pos"), F.col("size"), F.col("pos_2"), F.col("size_2")) & _parities_admit(FOLDED)
    return member.join(other, "gram").where((F.col("part") < F.col("part_2")) & admits & ~F.arrays_overlap("ahead", "ahead_2"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest (64 bits of the text), component_id, stays for every row of ``docs``: texts that links of a five-word similarity of 0.8 or more join.

    Every link is verified on the two texts, and no pair at 0.8 or more is left in different groups, so recall is 1 at 0.8 and above, and
    no link is below it:

    1. SimHash of 192 bits, in tables as wide as the number of rows asks for, finds most near copies by ball hashing.
    2. Texts at 0.8 or more share a shingle at their heads (``_head``), whatever their fingerprints. Of those that
       share one, each is tried with the first and the one before it.
    3. Of those that share one and are not yet in one group, every pair is tried whose sizes, places and parities admit 0.8;
       these bounds never refuse a pair at 0.8. A pair is listed about once (``met_once``), not at each shingle that it shares.

    Exact but for chance collisions of 64-bit hashes. component_id is the smallest doc_id of the group; ``stays`` marks the row of
    that doc_id (rows that repeat its text with it). Null and wordless texts are one group. A doc_id with several texts is as many
    documents; one without an id comes after all others. An empty table gives no row.
    """
    found = written(prints(docs, common_grams(docs)), "similar-prints")
    nodes = durable(found.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row"), *[F.first(x).alias(x) for x in ("f0", "f1", "f2", *PARITY, "size")]))
    rows = found.select("key", "size", "head").groupBy("key").agg(F.first("size").alias("size"), F.first("head").alias("head")).select("key", "size", F.posexplode("head").alias("pos", "gram"))
    of_gram = Window.partitionBy("gram").orderBy("key")
    here = F.struct("key", "pos", "size")
    shared = rows.select("gram", "key", "pos", "size", F.lag(here).over(of_gram).alias("before"), F.first(here).over(of_gram).alias("first"), F.lead("key").over(of_gram).alias("next"))
    shared = written(shared.where("before is not null or next is not null").drop("next"), "similar-heads")
    star = shared.where("before is not null").select("key", "pos", "size", F.explode(F.array_distinct(F.array("before", "first"))).alias("o"))
    star = star.where(_can_be_near(F.col("pos"), F.col("size"), F.col("o.pos"), F.col("o.size"))).select(F.least("key", "o.key").alias("a"), F.greatest("key", "o.key").alias("b"))
    bounds = nodes.select("key", "size", *PARITY)

    def admitted(pairs: DataFrame) -> DataFrame:
        """Without pairs whose sizes or parities say that they are not similar."""
        other = bounds.select(F.col("key").alias("b"), *[F.col(x).alias(f"{x}_2") for x in ("size", *PARITY)])
        return pairs.join(bounds.withColumnRenamed("key", "a"), "a").join(other, "b").where(_parities_admit(PARITY)).select("a", "b")

    tried = durable(admitted(simhash_pairs(nodes.select("key", "f0", "f1", "f2"), table_bits(nodes.count())).union(star).distinct()))

    def texts(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = durable(nodes.join(keys, "key", "left_semi").select("key", F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")))
        slot = lambda i, d: F.pmod(F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit("")), d), F.lit(SLOTS))
        used = F.broadcast(ids.select(slot("_id", "_digest").alias("_slot")).distinct())  # SLOTS rows at most; spares most texts the shuffle
        some = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.xxhash64("text")).withColumn("_slot", slot("doc_id", "digest")).join(used, "_slot", "left_semi")
        some = some.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
        return some.groupBy("key").agg(F.first("text").alias("text"))

    edges = durable(verified(tried, texts(tried)))
    parts = components(edges)
    member = shared.select("gram", "key", "pos", "size").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("label", "key")).drop("label")
    apart = member.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("gram")
    member = member.join(apart, "gram", "left_semi").join(nodes.select("key", *_folded()), "key")
    ahead = F.collect_list("gram").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-AHEAD, -1))
    member = written(member.withColumn("ahead", ahead), "similar-members")
    met = met_once(member)
    rest = admitted(met.select(F.least("key", "key_2").alias("a"), F.greatest("key", "key_2").alias("b")).distinct()).join(tried, ["a", "b"], "left_anti")
    rest = durable(rest)
    parts = components(edges.union(verified(rest, texts(rest))))
    labelled = nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "row", F.coalesce("label", "key").alias("label"))
    best = labelled.groupBy("label").agg(F.min("row").alias("best"))
    of_key = labelled.join(best, "label").select("key", "best")
    out = found.select("doc_id", "digest", "key").join(of_key, "key")
    return out.select("doc_id", "digest", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("stays"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of similar texts, the one of the smallest doc_id; columns as given, whatever their names.

    Rows that repeat one text under one doc_id stay together: see ``exact_dedup.drop_duplicates``. Otherwise as ``similar_groups``.
    """
    gone = similar_groups(docs).where(~F.col("stays")).select(F.col("doc_id").alias("id"), F.col("digest").alias("of_text")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64(text_or_empty()).alias("digest"))
    kept = rows.join(gone, rows["key"].eqNullSafe(gone["id"]) & (rows["digest"] == gone["of_text"]), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
