"""Operator 13, alignment of two tokenizers by divide and conquer at shared cuts.

Two segmentations of the same bytes have cuts in common: offsets at which a token ends in both. A common end near the middle is located by
bisection, both halves are treated alike, and an interval without an inner common end is a leaf group of tokens. Both vocabularies always end
a token where a word ends before a space or line feed, so a text's first cuts are known there and the intervals between them, which repeat far more
often than texts, are encoded and divided once for each distinct one in a worker.

Links are the pairs of tokens whose bytes overlap. How many documents hold a pair is counted by Spark over all documents, and joined back.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import attached, id_as_text, id_restored, remembered, shared_path, text_or_empty
from plotline.llm.tokens import _BYTE_CHARS, ChunkEncoder, _tokenizer, public_path, space_chunks

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: An id pair is one number: the id of A times this, plus the id of B.
PAIR = 1 << 32
#: A worker remembers so many intervals, and so many characters of them, before it begins anew; the encoder beside it far fewer.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_TOKENS = 600_000, 1 << 24, 20_000
#: Texts end their tokens in both vocabularies before a space or line feed that follows anything but white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Where an ASCII mark follows a letter or digit, a byte-level token ends; apostrophes may begin an ending.
_MARKED = re.compile(r"(?<=[^\W_])(?=[!-&(-/:-@\[-`{-~])")


def divide(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> np.ndarray:
    """The tokens of A after which a cut is shared, ascending, in many texts at once: text i has the ends from starts[i] up to starts[i + 1].

    Ends ascend over all texts, and the last ends of a text are equal. Each interval asks for the common end nearest to its middle token of A: outwards from there,
    an end of A is looked up among those of B by bisection. Both halves follow; an interval without a common end inside is a leaf. All intervals of all texts take their steps together.
    """
    some = starts_a[1:] > starts_a[:-1]
    a0, a1, b0, b1 = starts_a[:-1][some], starts_a[1:][some], starts_b[:-1][some], starts_b[1:][some]
    step = np.zeros(len(a0), np.int64)
    leaves = []
    while len(a0):
        at = (a0 + a1 - 1) // 2 + ((step + 1) >> 1) * np.where(step & 1, 1, -1)
        inside = (at >= a0) & (at < a1 - 1)  # the last end is the interval's own
        b = np.searchsorted(ends_b, ends_a[np.where(inside, at, a0)])
        hit = inside & (b < b1 - 1)
        hit[hit] = ends_b[b[hit]] == ends_a[at[hit]]
        over = ~hit & (step + 1 >= a1 - a0)
        leaves.append(a1[over] - 1)
        more = ~hit & ~over
        at, b = at[hit], b[hit]
        a0, a1, b0, b1 = (np.concatenate([x[more], y, z]) for x, y, z in ((a0, a0[hit], at + 1), (a1, at + 1, a1[hit]), (b0, b0[hit], b + 1), (b1, b + 1, b1[hit])))
        step = np.concatenate([step[more] + 1, np.zeros(2 * len(at), np.int64)])
    return np.sort(np.concatenate([*leaves, np.zeros(0, np.int64)]))


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and B whose bytes overlap, pair by pair in order. Between two ends next to each other, whichever side's, one token of each is at hand."""
    ends = np.unique(np.concatenate([ends_a, ends_b]))
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The piece model, and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        of.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8", "surrogatepass"))
    return model, of


@lru_cache(maxsize=2)
def _byte_entries(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    of_char = {c: b for b, c in _BYTE_CHARS.items()}
    entries = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(of_char[c] for c in entry) if all(c in of_char for c in entry) else entry.encode()
    return out


@lru_cache(maxsize=2)
def _neighbours(path: str) -> frozenset[str]:
    """The pairs of signs that stand side by side in a piece. Between two others no piece joins what is on both sides."""
    model, _ = _pieces(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))


class Aligner:
    """Intervals of texts between known cuts, and the columns of what is known of each by its number; -1 where its bytes differ from the text.

    ``words`` has intervals of a space and what follows it by the latter, and those that begin with a line feed; ``parts`` all others.
    """

    def __init__(self, path_a: str, path_b: str):
        self.tokens = ChunkEncoder(path_a, space_chunks)
        self.bytes_a = _byte_entries(path_a)
        self.model, self.bytes_b = _pieces(path_b)
        self.joined = _neighbours(path_b)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.start, self.feed = self.model.piece_to_id("▁"), self.model.piece_to_id("<0x0A>")
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sizes = array("q")  # tokens of A and B, groups, links of each
        self.pairs, self.ends = array("q"), array("q", [0])

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's intervals, in order; none for texts that one of the vocabularies cannot give back."""
        cut = [self._words(t) for t in texts]
        self._learn({w for words, _ in cut for w in words if w not in self.words}, {p for _, parts in cut for p in parts if p not in self.parts})
        found = [list(map(self.words.__getitem__, words)) if words else list(map(self.parts.__getitem__, parts)) for words, parts in cut]
        return [[] if -1 in x else x for x in found]

    @staticmethod
    def _words(text: str) -> tuple[list[str], list[str]]:
        """A text's intervals by ``words``, or where white space stands beside white space by ``parts``."""
        if not text:
            return [], []
        words = text.replace("\n", " \n").split(" ")
        if "" in words or "\n" in words or text[0] == "\n":
            return [], _CUT.split(" " + text)
        return words, []

    def _learn(self, words: set[str], parts: set[str]) -> None:
        """Takes in new intervals: marks after a word are apart where no token joins them to it, so that most new words are made of known ones."""
        made: list[tuple[dict, str, str, str]] = []
        new: dict[str, None] = {}
        parts_known, joined = self.parts, self.joined
        for known, key in [*((self.words, w) for w in words), *((parts_known, p) for p in parts)]:
            self.chars += len(key)
            head, tail = key if known is parts_known or key[0] == "\n" else " " + key, ""
            if (m := _MARKED.search(head)) and head[(at := m.start()) - 1 : at + 1] not in joined:
                head, tail = head[:at], head[at:]
                if tail not in parts_known:
                    new[tail] = None
            if head not in parts_known:
                new[head] = None
            made.append((known, key, head, tail))
        if new:
            self._encode(list(new))
        groups, sizes, pairs, ends = self.groups, self.sizes, self.pairs, self.ends
        for known, key, head, tail in made:
            i = parts_known[head]
            if not tail:
                known[key] = i
                continue
            j = parts_known[tail]
            if i < 0 or j < 0:
                known[key] = -1
                continue
            known[key] = len(groups)
            groups.append(f"{groups[i]};{groups[j]}")
            m, n = 4 * i, 4 * j
            sizes.extend((sizes[m] + sizes[n], sizes[m + 1] + sizes[n + 1], sizes[m + 2] + sizes[n + 2], sizes[m + 3] + sizes[n + 3]))
            pairs.extend(pairs[ends[i] : ends[i + 1]])
            pairs.extend(pairs[ends[j] : ends[j + 1]])
            ends.append(len(pairs))

    def _encode(self, parts: list[str]) -> None:
        """Both encodings of intervals, their division and their links. The piece model puts a space before all that it encodes: the interval's own, or one that goes."""
        if len(self.tokens) > REMEMBERED_TOKENS:
            self.tokens.clear()
        of_a = [array("I", self.tokens[p]) for p in parts]
        of_b = self.model.encode([p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in parts], num_threads=1)
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        for i, part in enumerate(parts):
            if part == " ":
                of_b[i] = [self.start]
            elif part[0] != " ":
                of_b[i] = of_b[i][2:] if of_b[i][:2] == [self.start, self.feed] else []
            if b"".join(map(self.bytes_a.__getitem__, of_a[i])) != raw[i] or b"".join(map(self.bytes_b.__getitem__, of_b[i])) != raw[i]:
                self.parts[part] = -1
                of_a[i], of_b[i] = (), ()
        starts_a, starts_b = (np.concatenate([[0], np.cumsum(list(map(len, x)))]).astype(np.int64) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n[-1]) for x, n in ((of_a, starts_a), (of_b, starts_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut = divide(ends_a, ends_b, starts_a, starts_b)
        cut_b = np.searchsorted(ends_b, ends_a[cut])
        i, j = links(ends_a, ends_b)
        n_groups = np.searchsorted(cut, starts_a)
        n_links = np.searchsorted(i, starts_a)
        sizes = np.stack([np.diff(starts_a), np.diff(starts_b), np.diff(n_groups), np.diff(n_links)], 1)
        # the groups of all parts as one list of texts: ids, each followed by what stands between it and the next
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[cut], after_b[cut_b] = 1, 1
        text_a = [x + (",", "|")[y] for x, y in zip(map(str, a.tolist()), after_a.tolist(), strict=True)]
        text_b = [x + (",", ";")[y] for x, y in zip(map(str, b.tolist()), after_b.tolist(), strict=True)]
        ahead, behind = (cut + 1).tolist(), (cut_b + 1).tolist()
        at_a = at_b = 0
        groups = []
        for m, n in zip(ahead, behind, strict=True):
            groups.append("".join(text_a[at_a:m]) + "".join(text_b[at_b:n]))
            at_a, at_b = m, n
        good = np.flatnonzero(sizes[:, 0])
        first = len(self.groups)
        bounds = n_groups.tolist()
        self.groups += ["".join(groups[bounds[k] : bounds[k + 1]])[:-1] for k in good.tolist()]
        self.parts.update(zip([parts[k] for k in good.tolist()], range(first, first + len(good)), strict=True))
        self.sizes.frombytes(np.ascontiguousarray(sizes[good]).tobytes())
        self.ends.frombytes((len(self.pairs) + np.cumsum(sizes[good, 3])).tobytes())
        self.pairs.frombytes((a[i] * PAIR + b[j]).tobytes())


def _aligner(path_a: str, path_b: str) -> Aligner:
    found = remembered(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
    if len(found.words) + len(found.parts) > REMEMBERED or found.chars > REMEMBERED_CHARS:
        found.forget()
    return found


ALIGNED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def align(docs: DataFrame, *, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the numbers of tokens in both vocabularies, of groups and of links, the groups, its id pairs and how often it links each.

    groups: ``a1,a2|b1;a3|b2,b3`` in order of the text, where A encodes a space and the text and B the text, whole and without special tokens. A pair is
    ``PAIR`` times the id of A, plus the id of B. Null and empty texts, and those that one of the vocabularies cannot give back byte for byte, have no
    tokens: zeros and empty values. Rows are independent, so repeated rows repeat. Other columns of ``docs`` are not read. An empty table gives no row.
    """
    path_a, path_b = a or public_path(A_MODEL), b or public_path(B_MODEL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start = 0
            while start < len(pdf):  # about a million characters at a time
                stop, size = start, 0
                while stop < len(pdf) and size < 1 << 20:
                    size += len(pdf["text"].iat[stop])
                    stop += 1
                yield _aligned(pdf.iloc[start:stop], _aligner(path_a, path_b))
                start = stop

    return id_restored(id_as_text(docs, text_or_empty().alias("text")).mapInPandas(run, ALIGNED), docs)


def _aligned(pdf: pd.DataFrame, known: Aligner) -> pd.DataFrame:
    """``align`` for some rows, by the columns of their intervals."""
    found = known.numbers(list(pdf["text"]))
    at = [np.array(x, np.int64) for x in found]
    groups = [";".join(map(known.groups.__getitem__, x)) for x in found]
    sizes = np.frombuffer(known.sizes, np.int64).reshape(-1, 4) if known.sizes else np.zeros((0, 4), np.int64)
    ends = np.frombuffer(known.ends, np.int64)
    every = np.frombuffer(known.pairs, np.int64) if known.pairs else np.zeros(0, np.int64)
    totals, pairs, times = np.zeros((len(pdf), 4), np.int64), [], []
    for k, parts in enumerate(at):
        totals[k] = sizes[parts].sum(axis=0)
        parts, often = np.unique(parts, return_counts=True)
        n = ends[parts + 1] - ends[parts]
        places = np.arange(n.sum()) + np.repeat(ends[parts] - np.cumsum(n) + n, n)
        found, inverse = np.unique(every[places], return_inverse=True)
        pairs.append(found)
        times.append(np.bincount(inverse, weights=np.repeat(often, n), minlength=len(found)).astype(np.int32))
    del ends, every, sizes  # else their arrays cannot grow
    columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals.T, strict=True))
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()} | columns | {"groups": groups, "pairs": pairs, "times": times})


def alignment(docs: DataFrame, *, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``; see ``align``.

    A pair's count is the number of rows that link it, over all of ``docs``. count_sum adds the counts of a row's links; n_best are its links whose count is the
    highest of any pair of the same id of A, ties included. groups_sha256 is the hex digest of the groups, empty without tokens.
    """
    spark = docs.sparkSession
    found = align(docs, a=a, b=b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    path = shared_path(spark, "alignment")
    found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times").write.parquet(path)
    kept = spark.read.parquet(path)
    counts = kept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts_path = shared_path(spark, "pair-counts")
    counts.write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    id_a = F.shiftright("pair", 32)
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("count").alias("most"))  # one row for each id of A: a vocabulary's size at most
    ranked_path = shared_path(spark, "pair-ranks")
    counts.withColumn("id_a", id_a).join(F.broadcast(most), "id_a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")).write.parquet(ranked_path)
    of_row = kept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = attached(of_row, spark.read.parquet(ranked_path), ["pair"])
    sums = sums.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = kept.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
