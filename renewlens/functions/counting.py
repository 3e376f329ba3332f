"""Words of a text counted where the text lies: Arrow batches in, rows of the same texts out.

No row leaves its batch and only a bounded number of words is unfolded at a time, so
memory does not depend on how many texts a task reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are unfolded at a time; a longer text is a piece of its own.
PIECE_WORDS = 500_000

Batches = Iterator[pa.RecordBatch]


def _pieces(batch: pa.RecordBatch, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose ``lengths`` add up to about PIECE_WORDS."""
    number = np.cumsum(lengths) // PIECE_WORDS
    ends = [*(np.flatnonzero(np.diff(number)) + 1), len(batch)]
    for start, end in zip([0, *ends[:-1]], ends):
        if end > start:
            yield batch.slice(start, end - start)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of every word in the list of different words, and that list."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_counts(keep: list[str]) -> Callable[[Batches], Batches]:
    """Rows (``keep``, word, tf) per different word of ``found``, a list of words per row."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = piece.column("found")
        code, different = _codes(found.flatten())
        row = np.repeat(np.arange(len(piece)), _lengths(found))
        key, tf = np.unique(row * max(1, len(different)) + code, return_counts=True)
        row, code = np.divmod(key, max(1, len(different)))
        kept = [piece.column(c).take(pa.array(row)) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, different.take(pa.array(code)), pa.array(tf.astype(np.int64))], [*keep, "word", "tf"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for piece in _pieces(batch, _lengths(batch.column("found"))):
                yield count(piece)

    return run


def best_sentences(keep: list[str], n: int) -> Callable[[Batches], Batches]:
    """Rows (``keep``, sentence_no, sentence, score): the ``n`` of ``listed`` whose words, in ``found``, have the highest mean frequency in the row.

    Ties go to the earlier sentence; sentences without a word are left out.
    """

    def best(piece: pa.RecordBatch) -> pa.RecordBatch:
        found, listed = piece.column("found"), piece.column("listed")
        per_row, inner = _lengths(found), found.flatten()
        per_sentence = _lengths(inner)
        row = np.repeat(np.arange(len(piece)), per_row)
        number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        sentence = np.repeat(np.arange(len(row)), per_sentence)
        code, different = _codes(inner.flatten())
        _, place, counts = np.unique(row[sentence] * max(1, len(different)) + code, return_inverse=True, return_counts=True)
        total = np.bincount(sentence, weights=counts[place], minlength=len(row))
        at = np.flatnonzero(per_sentence)
        score = total[at] / per_sentence[at]
        order = np.lexsort((number[at], -score, row[at]))
        at, score = at[order], score[order]
        first = np.searchsorted(row[at], row[at])
        chosen = np.arange(len(at)) - first < n
        at, score = at[chosen], score[chosen]
        kept = [piece.column(c).take(pa.array(row[at])) for c in keep]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(number[at].astype(np.int32)), listed.flatten().take(pa.array(at)), pa.array(score)],
            [*keep, "sentence_no", "sentence", "score"],
        )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = batch.column("found")
            ends = np.concatenate(([0], np.cumsum(_lengths(found.flatten()))))
            upto = ends[np.concatenate(([0], np.cumsum(_lengths(found))))]
            for piece in _pieces(batch, np.diff(upto)):
                yield best(piece)

    return run
