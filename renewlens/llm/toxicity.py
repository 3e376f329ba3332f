"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that toxic rows of the sample hold far more often than others.
Features are lexicon densities, how close lexicon words stand to second-person words, and rates of
capitals, punctuation and disguised spellings. To keep the lexicon from flattering its own rows, rows
are dealt over folds and see a lexicon of the other folds only; the calibration rests on out-of-fold trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees, isotonic
from .common import held_out, labelled_sample, small_batches, stored, table, text_chunks

FEATURES = (
    "hits", "log_hits", "weight", "heaviest", "kinds", "disguised_hits", "second_person", "hits_near_you",
    "capitals", "shouted_words", "exclaims", "symbols", "disguised", "log_words",
)
FOLDS = 3
#: Terms of a lexicon; rows that must hold a term; how much likelier (log) it must be in a toxic row.
LEXICON_TERMS, LEAST_ROWS, LEAST_WEIGHT = 2_000, 3, 2.0
#: Lengths of word beginnings that may be terms.
STEMS = (4, 5, 6, 7)
#: Words between a lexicon word and a second-person word.
NEAR = 5
#: Entries of a worker's memory of tokens before it is emptied.
MEMORY = 300_000
THRESHOLD = 0.7
#: Labelled rows that lexicon, trees and calibration are fitted on.
ROWS = 10_000
# Second-person words of the languages at hand.
YOU = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr "
    "sie usted ustedes ti tus su vosotros".split()
)
# Signs that stand for letters in disguised words.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_OPENING = '"([|'
_MARKS = '.,;:!?"()[]|*#%&$'
_EDGE = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}]+$")
_MIXED = regex.compile(r"\p{L}[^\p{L}\s'’-]+\p{L}|\p{L}[013457@$!]+\p{L}|^[@$]\p{L}|^\p{L}(?:[.\-_*]\p{L}){2,}$")
_NO_LETTER = regex.compile(r"[^\p{L}]+")
_REPEATED = regex.compile(r"(.)\1{2,}")


def spellings(token: str) -> tuple[str, str, bool]:
    """(plain word, word behind the disguise, disguised?) of a token between white space."""
    word = token.lstrip(_OPENING).rstrip(_MARKS).lower()
    if word.isalpha():
        if not _REPEATED.search(word):
            return word, "", False
    else:
        word = _EDGE.sub("", word)
        if not _MIXED.search(word):
            return word, "", False
    return word, _REPEATED.sub(r"\1", _NO_LETTER.sub("", word.translate(LOOKS_LIKE))), True


def keys(word: str) -> tuple[str, ...]:
    """The lexicon terms that a word can match; a trailing * marks a beginning."""
    return (word, *[word[:n] + "*" for n in STEMS if len(word) > n])


@lru_cache(maxsize=200_000)
def terms(token: str) -> frozenset[str]:
    plain, hidden, _ = spellings(token)
    return frozenset(t for w in (plain, hidden) if w for t in keys(w))


class Reader:
    """Turns texts into features with one lexicon; remembers what each token means."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple[float, bool, bool, bool]] = []

    def learn(self, token: str) -> int:
        plain, hidden, disguised = spellings(token)
        get = self.lexicon.get
        weight = max([get(t, 0.0) for t in keys(plain)]) if plain else 0.0
        behind = max([get(t, 0.0) for t in keys(hidden)]) if hidden else 0.0
        self.known[token] = len(self.rows)
        self.rows.append((max(weight, behind), disguised, disguised and behind > 0, plain in YOU, token.isupper() and len(token) > 3))
        return self.known[token]

    def features(self, raw: bytes) -> list[float]:
        text = raw.decode("utf-8", "replace")
        tokens = text.split()
        if not tokens:
            return [0.0] * len(FEATURES)
        get, learn = self.known.get, self.learn
        seen = np.array([n if (n := get(t)) is not None else learn(t) for t in tokens], dtype=np.int64)
        kinds = np.unique(seen)
        facts = np.array([self.rows[n] for n in kinds.tolist()], dtype=float)[np.searchsorted(kinds, seen)]
        weight, n, size = facts[:, 0], len(tokens), len(text)
        hit = np.nonzero(weight > 0)[0]
        you = np.nonzero(facts[:, 3] > 0)[0]
        near = 0
        if len(hit) and len(you):
            after = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hit), np.abs(you[np.maximum(after - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        bytes_ = np.frombuffer(raw, dtype=np.uint8)
        return [
            len(hit) / n,
            np.log1p(len(hit)),
            weight.sum() / n,
            weight.max(),
            len(set(seen[hit].tolist())),
            facts[:, 2].sum() / n,
            len(you) / n,
            near / n,
            np.count_nonzero((bytes_ >= 65) & (bytes_ <= 90)) / size,
            facts[:, 4].mean(),
            (text.count("!") + text.count("?")) / size,
            sum(text.count(c) for c in "#$%&*") / size,
            facts[:, 1].mean(),
            np.log1p(n),
        ]

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.clear()
        return np.array([self.features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    at: np.ndarray  # calibration points
    chance: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), self.at, self.chance) if len(self.at) else np.full(len(x), 0.5)


def learned_lexicons(sample: DataFrame) -> dict[int, dict[str, float]]:
    """Weights by term; key -1 from all rows, key k from the rows outside fold k. ``sample`` is (doc_id, y, fold, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found: dict[tuple[int, int, str], int] = {}
            for y, fold, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts):
                for term in frozenset().union(*map(terms, set(raw.decode("utf-8", "replace").split()))):
                    found[y, fold, term] = found.get((y, fold, term), 0) + 1
            columns = list(zip(*((y, fold, term, n) for (y, fold, term), n in found.items()))) or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["y", "fold", "term", "n"])

    held = stored(
        sample.select("doc_id", "y", "fold", "text").mapInArrow(count, "y int, fold int, term string, n long")
        .groupBy("term", "y", "fold").agg(F.sum("n").alias("n")),
        "toxic-terms",
    )
    sizes = {(r["y"], r["fold"]): r["n"] for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    out = {}
    for fold in (-1, *range(FOLDS)):
        toxic, other = (sum(n for (y, f), n in sizes.items() if y == k and f != fold) for k in (1, 0))
        used = held.filter(F.col("fold") != fold).groupBy("term").agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"),
        )
        weight = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
        best = (
            used.filter(F.col("a") >= LEAST_ROWS).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc(F.col("weight") * F.sqrt("a")), "term").limit(LEXICON_TERMS)
        )
        out[fold] = {r["term"]: r["weight"] for r in best.select("term", "weight").collect()}
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", rows: int = ROWS) -> Model | None:
    """Fit on labelled rows outside the hold-out; None if there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = labelled_sample(docs, labels, "toxic", text, id_col, rows).select("doc_id", "y", fold.alias("fold"), "text")
    lexicons = learned_lexicons(sample)
    shared = spark.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {k: Reader(x) for k, x in shared.value.items()}
        for batch, texts in text_chunks(batches):
            x = [readers[k].matrix([t])[0].tolist() for k, t in zip(batch.column(2).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(x, type=pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"]
            )

    found = sample.mapInArrow(run, "doc_id long, y int, fold int, x array<double>").toArrow()
    if not found.num_rows:
        return None
    x, y = np.array(found["x"].to_pylist(), dtype=float), found["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    x, y, folds = x[order], y[order], found["fold"].to_numpy()[order]
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (folds == k).any() and (folds != k).any():
            raw[folds == k] = fit_trees(x[folds != k], y[folds != k]).raw(x[folds == k])
    return Model(lexicons[-1], fit_trees(x, y), *isotonic(raw, y))


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) per row of ``docs``: the calibrated probability of label 1.

    NULL and empty texts are scored as an empty text; without a model every
    score is 0. Rows stay rows, also with equal or NULL ids; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.lexicon if model else {})
        for batch, texts in text_chunks(batches):
            score = model.score(reader.matrix(texts)) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
