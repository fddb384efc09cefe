"""Operator 1, language identification: segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word is scored by the forward
algorithm, which sums the probabilities of *all* its segmentations into pieces; a text is the product over its words.
The probabilities are fitted by expectation-maximisation on word counts of a bounded, hashed sample of labelled rows.

Pieces of this vocabulary never cross a word start, so the sum over the segmentations of a text is the product of
the sums over its words; each distinct word is therefore scored once per worker, for all languages at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.llm.common import remembered
from plotline.llm.pieces import PieceTable

UNDETERMINED = "und"
WORD_START = "▁"
#: Probability of a character that no piece covers, and of a piece unseen in a language.
UNKNOWN_P, FLOOR_P = 1e-7, 1e-9
#: Rows per language that training reads, in expectation.
TRAIN_ROWS = 2000
EM_ROUNDS = 3
#: Texts that are scored at a time.
SLICE_ROWS = 300
#: Distinct words that a worker remembers.
CACHE_WORDS = 300_000
#: Runs of letters and of other characters that count as alphanumeric; these are told apart in ``letters``.
_RUN = re.compile(r"[^\W\d_]+")


def letters(run: str) -> list[str]:
    """The words of a run: its runs of letters (general category L), as ``\\p{L}+`` in Spark."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces of the vocabulary file, in its order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in found if p == p.lower() and (p.removeprefix(WORD_START).isalpha() or p == WORD_START)]


@lru_cache(maxsize=4)
def _table(path: str) -> PieceTable:
    return PieceTable(vocabulary(path))


def lattice(words: list[str], path: str) -> list[tuple[int, np.ndarray]]:
    """Edges of words of one length; a character that is no piece has the number ``len(vocabulary)``."""
    return _table(path).edges(words)


def forward(edges: list[tuple[int, np.ndarray]], p: np.ndarray) -> np.ndarray:
    """Log probability of each word for each column of ``p``, summed over all segmentations.

    ``p`` has a row for each piece, one for unknown characters and a last row of zeros for absent edges.
    """
    n, length = edges[0][1].shape
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros((n, p.shape[1]))
    longest = edges[-1][0]
    for j in range(1, length + 1):
        for k, ids in edges:
            if k <= j:
                alpha[j] += alpha[j - k] * p[ids[:, j - k]]
        if j % 16 == 0:
            low = max(0, j - longest)
            top = alpha[low : j + 1].max(axis=0)
            alpha[low : j + 1] /= top
            scale += np.log(top)
    return np.log(alpha[length]) + scale


def fit_language(words: list[str], counts: np.ndarray, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations of its words."""
    size = len(vocabulary(path))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    data = [(lattice([words[i] for i in at], path), counts[at]) for at in groups.values()]
    # logarithms: a word may be as long as a text
    p = np.full(size + 2, -np.log(size))
    p[size], p[size + 1] = np.log(UNKNOWN_P), -np.inf
    for _ in range(rounds):
        gathered = np.zeros(size + 2)
        for edges, weight in data:
            n, length = edges[0][1].shape
            alpha, beta = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
            alpha[0] = beta[length] = 0.0
            for j in range(1, length + 1):
                for k, ids in edges:
                    if k <= j:
                        np.logaddexp(alpha[j], alpha[j - k] + p[ids[:, j - k]], out=alpha[j])
                        np.logaddexp(beta[length - j], beta[length - j + k] + p[ids[:, length - j]], out=beta[length - j])
            for k, ids in edges:
                for i in range(length - k + 1):
                    gathered += np.bincount(ids[:, i] % (size + 2), weight * np.exp(alpha[i] + p[ids[:, i]] + beta[i + k] - alpha[length]), size + 2)
        p[:size] = np.log(np.maximum((gathered[:size] + 0.01) / (gathered[:size].sum() + 0.01 * size), FLOOR_P))
    return np.exp(p)


def train(labelled: DataFrame, *, vocabulary_path: str | None = None, rows_per_language: int = TRAIN_ROWS) -> pd.DataFrame:
    """The model: columns lang and p (a list over pieces). ``labelled`` has doc_id, text and lang.

    The sample is bounded by ``rows_per_language`` (in expectation, by a hash of doc_id); the languages are counted and
    fitted apart, each as one Spark group of word counts. Rows with null text or lang are not read.
    """
    path = vocabulary_path or default_vocabulary()
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return pd.DataFrame({"lang": [], "p": []})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_language / n))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = (
        rows.where(unit < F.element_at(share, F.col("lang")))
        .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = fit_language([WORD_START + w for w in pdf["word"]], pdf["n"].to_numpy(float), path)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.tolist()]})

    # one row for each language, as long as the vocabulary
    return words.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").toPandas().sort_values("lang", ignore_index=True)


class Scorer:
    """Scores batches of texts; remembers the runs of letters that it has scored."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.known, self.worded = np.zeros((0, len(self.langs))), np.zeros(0, bool)

    def learn(self, runs: list[str]) -> None:
        """Rows of new runs: the sum over their words, of which a run of numbers has none."""
        words = [letters(r) for r in runs]
        groups: dict[int, list[str]] = {}
        for w in {w for ws in words for w in ws}:
            groups.setdefault(len(w), []).append(w)
        score: dict[str, np.ndarray] = {}
        for group in groups.values():
            step = max(1, 500_000 // (len(group[0]) + 1) // max(1, len(self.langs)))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                score.update(zip(part, forward(lattice([WORD_START + w for w in part], self.path), self.p), strict=True))
        none = np.zeros(len(self.langs))
        found = [score[ws[0]] if len(ws) == 1 else sum((score[w] for w in ws), none) for ws in words]
        self.row.update(zip(runs, range(len(self.known), len(self.known) + len(runs)), strict=True))
        self.known = np.concatenate([self.known, np.array(found).reshape(len(runs), len(self.langs))])
        self.worded = np.concatenate([self.worded, np.array([bool(ws) for ws in words], bool)])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        runs = [_RUN.findall(t.lower()) if t else [] for t in texts]
        flat = [r for rs in runs for r in rs]
        new = set(flat) - self.row.keys()
        if len(self.row) + len(new) > CACHE_WORDS:
            self.forget()
            new = set(flat)
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(rs) for rs in runs])
        lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        if (full := np.flatnonzero(sizes)).size and self.langs:
            rows = np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            ll = np.add.reduceat(self.known[rows], starts, axis=0)
            worded = np.logical_or.reduceat(self.worded[rows], starts)
            full, ll = full[worded], ll[worded]
            post = np.exp(ll - ll.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            lang[full] = np.array(self.langs, dtype=object)[best]
            score[full] = post[np.arange(len(full)), best]
        return lang.tolist(), score


def _scored(docs: DataFrame, model: pd.DataFrame, columns: list[str], vocabulary_path: str | None = None) -> DataFrame:
    """``columns`` of ``docs`` by place as c0, c1 and so on, with lang_pred and score. Whole texts are read, some hundred at a time; no shuffle."""
    path = vocabulary_path or default_vocabulary()
    langs = model["lang"].tolist()
    table = np.array(model["p"].tolist(), dtype=float).T if langs else np.zeros((1, 0))
    table[-1] = 0.0
    shared = docs.sparkSession.sparkContext.broadcast(table)  # vocabulary x languages
    key = f"{path}|{hash(table.tobytes())}"
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *([] if "text" in columns else [F.col("text").alias("t")]))
    at = columns.index("text") if "text" in columns else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = remembered(key, lambda: Scorer(langs, shared.value, path))
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                lang, value = score(part.column(at).to_pylist())
                arrays = [*part.columns[: len(columns)], pa.array(lang, pa.string()), pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{k}" for k in range(len(columns))), "lang_pred", "score"])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema)


def predict(docs: DataFrame, model: pd.DataFrame, *, vocabulary_path: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with lang_pred and score; only ``text`` is an input of the prediction.

    Null texts and texts without a letter give ``und`` and 0. A column of ``docs`` named lang_pred or score is replaced. Repeated
    rows each get a row; an empty table gives none.
    """
    columns = [c for c in (columns or docs.columns) if c not in ("lang_pred", "score")]
    return _scored(docs, model, columns, vocabulary_path).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Rows that are never trained on: the remainder of crc32(doc_id as text) by 4 is 2."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, *, rows_per_language: int = TRAIN_ROWS, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: trained on the labelled rows that aren't held out.

    An empty table, or one without labels, gives no language: every row is ``und``. Repeated rows each get a row.
    A null doc_id counts as not held out.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out), vocabulary_path=vocabulary_path, rows_per_language=rows_per_language)
    found = predict(docs.select("doc_id", "text"), model, vocabulary_path=vocabulary_path, columns=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, min_score: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``; columns as given, whatever their names.

    Rows with null text, or without a letter, go. Repeated rows stay together. An empty table, or one without labels, gives no row.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out), **options)
    kept = _scored(docs, model, docs.columns).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
