"""Quality scores from a generalised additive model with pairwise interactions.

Features are shares and ratios of a text's bytes, words and lines. Cyclic boosting fits one lookup table per
feature and a grid for each of a few pairs (``boosting.fit_additive``), on a bounded sample of labelled rows;
a score is the sum of the entries that a text's bins select, for all texts of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Additive, fit_additive
from .common import LABELLED_ROWS, held_out, labelled_sample, small_batches, table, text_chunks

FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "bars", "marks", "stops", "blanks", "breaks", "beyond_ascii",
    "word_length", "longest_word", "short_words", "distinct_words", "distinct_lines", "line_length", "packed", "packed_line",
    "unended_lines", "wordless",
)
#: Bytes that are compressed at a time to see how much a text repeats itself.
PACKED_BYTES = 1 << 16
#: What a word is left without: words of nothing else vanish.
_LETTERLESS = bytes(b for b in range(128) if not chr(b).isalpha() and not chr(b).isspace() or 28 <= b <= 31)
_UPPER, _DIGITS, _SYMBOLS = range(65, 91), range(48, 58), [ord(c) for c in "#$%&*@^~=+<>\\{}[]_"]


def features(text: bytes) -> list[float]:
    """One row of FEATURES; all zero for an empty text."""
    size = len(text)
    if not size:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    filled = [x for x in lines if x.strip()]
    packed = sum(len(zlib.compress(text[a : a + PACKED_BYTES], 1)) for a in range(0, size, PACKED_BYTES))
    ended = sum(x.rstrip()[-1:] in b".!?:;" for x in filled)
    return [
        np.log(size),
        hist[_UPPER].sum() / size,
        hist[_DIGITS].sum() / size,
        hist[_SYMBOLS].sum() / size,
        hist[ord("|")] / size,
        (hist[ord("!")] + hist[ord("?")]) / size,
        (hist[ord(".")] + hist[ord(",")]) / size,
        hist[32] / size,
        hist[10] / size,
        hist[128:].sum() / size,
        lengths.mean(),
        np.log1p(lengths.max()),
        (lengths <= 3).mean(),
        len(set(words)) / max(1, len(words)),
        len(set(filled)) / max(1, len(filled)),
        np.log1p(size / max(1, len(filled))),
        packed / size,
        np.log1p(len(lines)),
        1 - ended / max(1, len(filled)),
        (len(words) - len(text.translate(None, _LETTERLESS).split())) / max(1, len(words)),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", rows: int = LABELLED_ROWS) -> Additive | None:
    """Fit on labelled rows outside the hold-out; None if there are none."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", text, id_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x = pa.array(matrix(texts).tolist(), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "y", "x"])

    found = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    if not found.num_rows:
        return None
    x, y = np.array(found["x"].to_pylist(), dtype=float), found["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))  # the same model for any order of rows
    return fit_additive(x[order], y[order])


def score_quality(docs: DataFrame, model: Additive | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) per row of ``docs``: the probability of label 1.

    NULL and empty texts are scored as an empty text; without a model every
    score is 0.5. Rows stay rows, also with equal or NULL ids; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            score = shared.value.score(matrix(texts)) if shared.value is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
