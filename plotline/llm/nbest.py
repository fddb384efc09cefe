"""Operator 3, SentencePiece encoding and decoding: N-best segmentation.

The lattice of a text has an edge for each vocabulary piece at each place. A forward Viterbi pass gives every place the best
score of a segmentation up to it; these scores are an exact heuristic for an A* search from the end backwards, which
therefore yields segmentations in the order of their scores and expands little else.

No piece has a word mark after another character, so a lattice falls apart into those of its words: the N best of a text
take the best of every word but for the few words whose second best costs least. Viterbi passes run over all new words
of near lengths at a time in numpy; only words that a text's N best may change are searched.

A vocabulary of merges has ranks but no probabilities; a piece's score is the logarithm of a Zipf law over its rank. Characters
without a piece are spelt in byte pieces at a fixed penalty, so decoding gives back every text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import remembered, text_or_empty
from plotline.llm.pieces import PieceTable
from plotline.llm.tokens import public_path, slices

N = 4
MARK = "▁"
BYTE_SCORE = -25.0
CACHE_WORDS = 300_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces of a SentencePiece model file, their scores, and the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        special = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.pieces = ["" if i in special else sp.id_to_piece(i) for i in range(size)]
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has a word mark after another character")
        self.byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.spelling = np.array([self.byte_of.get(i) or p.encode() for i, p in enumerate(self.pieces)], dtype=object)
        self.table = PieceTable(self.pieces)
        self.longest = max(map(len, self.pieces))
        # one score for each piece, then one for characters without, and one for absent edges
        self.score = np.append(-np.log(np.arange(size) + 2.0), [BYTE_SCORE, -np.inf])
        self.number = {p: i for i, p in enumerate(self.pieces) if p}

    def spelt(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def marked(text: str) -> str:
    """The text as the model sees it: a mark for each space, and one before the text."""
    return MARK + text.replace(" ", MARK) if text else ""


def spelling(ids: bytes, v: Vocabulary) -> bytes:
    """The bytes that packed piece ids spell."""
    return b"".join(v.spelling[np.frombuffer(ids, "<u4")].tolist())


def unmarked(spelt: bytes) -> str:
    """The text of what a whole text's ids spell."""
    return spelt.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


def decode(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    """The text of piece ids."""
    return unmarked(spelling(np.asarray(ids, "<u4").tobytes(), v))


def a_star(word: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word, best first."""
    length = len(word)
    edges: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(length + 1)]  # by end: start, score, ids
    best = [0.0] + [-np.inf] * length
    for j in range(1, length + 1):
        for i in range(max(0, j - v.longest), j):
            k = v.number.get(word[i:j])
            if k is not None:
                edges[j].append((i, float(v.score[k]), [k]))
            elif j - i == 1:
                edges[j].append((i, BYTE_SCORE, v.spelt(word[i])))
        best[j] = max(best[i] + s for i, s, _ in edges[j])
    # entries: cost, order of entry, place, score from here to the end, path
    heap: list[tuple] = [(-best[length], 0, length, 0.0, None)]
    out, entered = [], 0
    while heap and len(out) < n:
        _, _, j, g, path = heapq.heappop(heap)
        if j == 0:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((g, ids))
            continue
        for i, s, ids in edges[j]:
            entered += 1
            heapq.heappush(heap, (-(g + s + best[i]), entered, i, g + s, (ids, path)))
    return out


def viterbi(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of words of about one length: best scores, costs of the second best segmentations, ids of the best.

    Shorter words are filled up; a word is read up to its own end, so what fills it takes no part.
    """
    sizes_of = np.fromiter(map(len, words), np.int64, len(words))
    longest = int(sizes_of.max())
    edges = v.table.edges([w.ljust(longest) for w in words])
    n, length = edges[0][1].shape
    rows = np.arange(n)
    front, back = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    came = np.zeros((length + 1, n), np.int8)  # index of the edge length
    front[0] = back[sizes_of, rows] = 0.0
    ids_at = [np.ascontiguousarray(ids.T) for _, ids in edges]  # by place
    scores = [v.score[x] for x in ids_at]
    for j in range(1, length + 1):
        best, way = front[j], came[j]
        for e, (k, _) in enumerate(edges):
            if k > j:
                break
            x = front[j - k] + scores[e][j - k]
            better = x > best
            np.copyto(best, x, where=better)
            np.copyto(way, e, where=better)
    for i in range(length - 1, -1, -1):
        for e, (k, _) in enumerate(edges):
            if i + k > length:
                break
            np.maximum(back[i], back[i + k] + scores[e][i], out=back[i])
    # walk back: which edges the best path takes
    sizes = np.array([k for k, _ in edges])
    taken = [np.zeros((length - k + 1, n), bool) for k, _ in edges]
    paths: list[np.ndarray] = []
    place, live = sizes_of.copy(), rows
    while live.size:
        step = np.full(n, -1)
        edge = came[place[live], live]
        for e in np.unique(edge).tolist():
            on = live[edge == e]
            at = place[on] - sizes[e]
            step[on] = ids_at[e][at, on]
            taken[e][at, on] = True
            place[on] = at
        paths.append(step)
        live = live[place[live] > 0]
    second = np.full(n, -np.inf)
    for e, (k, _) in enumerate(edges):
        for i in range(length - k + 1):
            np.maximum(second, front[i] + scores[e][i] + back[i + k], out=second, where=~taken[e][i])
    top = front[sizes_of, rows]
    gap = np.where(np.isneginf(second), np.inf, np.maximum(top - second, 0.0))
    path = np.array(paths[::-1]).T
    held = path >= 0
    flat, ends = path[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
    found = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    size = len(v.pieces)
    for w in np.flatnonzero((path == size).any(axis=1)).tolist():  # characters without a piece
        spelt, at = [], 0
        for i in path[w][held[w]].tolist():
            spelt += v.spelt(words[w][at]) if i == size else [i]
            at += 1 if i == size else len(v.pieces[i])
        found[w] = np.array(spelt, "<u4").tobytes()
    return top, gap, found


class Words:
    """What is known of words: their rows, and by row the best score, the cost of the second best, and the best ids."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.top, self.gap, self.ids = np.zeros(0), np.zeros(0), []

    def add(self, words: list[str], top: np.ndarray, gap: np.ndarray, ids: list[bytes]) -> None:
        self.row.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))
        self.top, self.gap = np.append(self.top, top), np.append(self.gap, gap)
        self.ids += ids


class Encoder:
    """N best segmentations of texts; remembers words."""

    def __init__(self, path: str, n: int):
        self.v, self.n = vocabulary(path), n
        self.known, self.older = Words(), Words()  # the older not seen for a generation
        self.search: dict[str, list[tuple[float, bytes]]] = {}

    def learn(self, words: list[str]) -> None:
        """Words of near lengths are filled up to one length and go through one lattice."""
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            most = len(words[at]) + len(words[at]) // 6
            stop = at + 1
            while stop < len(words) and len(words[stop]) <= most and (stop - at) * len(words[stop]) < 400_000:
                stop += 1
            self.known.add(words[at:stop], *viterbi(words[at:stop], self.v))
            at = stop

    def others(self, word: str, row: int) -> list[tuple[float, bytes]]:
        """(cost, ids) of the word's next best segmentations."""
        if word not in self.search:
            if len(self.search) > CACHE_WORDS:
                self.search.clear()
            top, best = float(self.known.top[row]), self.known.ids[row]
            found = [(s, np.array(ids, "<u4").tobytes()) for s, ids in a_star(word, self.v, self.n)]
            self.search[word] = [(max(0.0, top - s), ids) for s, ids in found if ids != best][: self.n - 1]
        return self.search[word]

    def text(self, words: list[str], rows: np.ndarray) -> list[tuple[float, bytes, str]]:
        """(score, ids, decoded text) of the N best segmentations of a text, best first.

        They differ in the words of ``change`` alone; what stands between these is joined and decoded once.
        """
        gaps = self.known.gap[rows]
        total = float(self.known.top[rows].sum())
        # a segmentation that changes any other word costs no less than each of these alone
        few = min(self.n - 1, len(words))
        change = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1]) if few else np.zeros(0, np.int64)
        change = change[np.argsort(gaps[change], kind="stable")[:few]].tolist()
        combined: list[tuple[float, tuple]] = [(0.0, ())]
        for at in change:
            if gaps[at] < np.inf:
                more = [(c + d, (*how, (at, ids))) for c, how in combined for d, ids in self.others(words[at], rows[at])]
                combined = heapq.nsmallest(self.n, combined + more, key=lambda x: x[0])
        places = sorted({at for _, how in combined for at, _ in how})
        ids = [self.known.ids[i] for i in rows.tolist()]
        parts: list[bytes] = []  # between the places, and each place's best
        start = 0
        for at in places:
            parts += [b"".join(ids[start:at]), ids[at]]
            start = at + 1
        parts.append(b"".join(ids[start:]))
        spelt = [spelling(x, self.v) for x in parts]
        index = {at: 2 * k + 1 for k, at in enumerate(places)}
        out = []
        for cost, how in combined:
            these, letters = list(parts), list(spelt)
            for at, other in how:
                these[index[at]], letters[index[at]] = other, spelling(other, self.v)
            out.append((total - cost, b"".join(these), unmarked(b"".join(letters))))
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[float, bytes, str]]]:
        words = [_WORDS.findall(marked(t)) for t in texts]
        flat = list(chain.from_iterable(words))
        used = set(flat)
        if len(self.known.row) + len(used) > CACHE_WORDS:
            self.known, self.older = Words(), self.known
        new = used - self.known.row.keys()
        if back := [w for w in new if w in self.older.row]:
            rows = np.array([self.older.row[w] for w in back])
            self.known.add(back, self.older.top[rows], self.older.gap[rows], [self.older.ids[i] for i in rows.tolist()])
            new.difference_update(back)
        self.learn(sorted(new))
        rows = np.fromiter(map(self.known.row.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(w) for w in words]).tolist()
        return [self.text(w, rows[end - len(w) : end]) for w, end in zip(words, ends, strict=True)]


def encoder(path: str, n: int) -> Encoder:
    return remembered(("nbest", path, n), lambda: Encoder(path, n))


def segment(docs: DataFrame, *, n: int = N, model_path: str | None = None) -> DataFrame:
    """doc_id, rank (from 1), score, ids (packed as little-endian unsigned 32-bit), decoded: up to n rows for each row of ``docs``.

    Whole texts. Null and empty texts have one segmentation of no piece and score 0; a text with fewer than n segmentations has
    as many rows. Equal scores keep the order of the search. Repeated rows each get rows. An empty table gives none.
    """
    path = model_path or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, n)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                found = encode(texts[a:b])
                of = pa.array(np.repeat(np.arange(a, b), [len(x) for x in found]))
                rows = [(rank, *x) for ranked in found for rank, x in enumerate(ranked, 1)]
                rank, score, ids, decoded = zip(*rows, strict=True)
                columns = [batch.column(0).take(of), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rank", "score", "ids", "decoded"])

    ids = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {ids}, rank int, score double, ids binary, decoded string")
