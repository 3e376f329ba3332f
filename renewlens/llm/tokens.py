"""Exact token counts by a two-tier lookup of pre-token lengths.

A text is cut into pre-tokens where it lies. How many tokens a pre-token has is
looked up in a broadcast table of frequent ones, then in the worker's cache, and
only what both miss is encoded by the tokenizer library. Pre-tokens of the corpus are never
shuffled: the table comes from a bounded sample of documents and only decides the speed, never the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, small_batches, table, text_chunks

#: Documents that the table of frequent pre-tokens is taken from, and its entries.
SAMPLE_ROWS, TABLE_ENTRIES = 4_000, 50_000
#: Entries of a worker's cache before it is emptied; longer pre-tokens are not kept.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 60
LIMIT = 1024
#: How byte-level BPE cuts texts.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points for which the pattern's classes are those of the tokenizer library; others take the library's own cutter.
UNSURE = regex.compile(r"[^\x00-\u0557\u1e00-\u2063\u3000-\u30ff\u4e00-\u9fcb\uac00-\ud7a3]")


@cache
def tokenizer(path: str):
    """The tokenizer of a .json file, one per worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def special_strings(path: str):
    """Pattern of the strings that the library turns into one token inside texts; None if there are none."""
    found = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(found, key=len, reverse=True)))) if found else None


def pieces(text: str, path: str) -> list[str]:
    """The pre-tokens of a text without special strings."""
    if UNSURE.search(text):
        return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return PIECES.findall(text)


class Counts:
    """The second tier: what this worker has encoded so far."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        self.path, self.frequent, self.cache = path, frequent, {}

    def encode(self, missing: list[str]) -> dict[str, int]:
        found = tokenizer(self.path).encode_batch(missing, add_special_tokens=False)
        return {m: len(e.ids) for m, e in zip(missing, found)}

    def of(self, texts: list[bytes]) -> list[int]:
        special, totals, cut = special_strings(self.path), [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            parts = special.split(text) if special else [text]
            totals.append(len(parts) - 1)
            cut.append([p for part in parts if part for p in pieces(part, self.path)])
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        once: set[str] = set()
        rest: list[Counter] = []
        for n, found in enumerate(cut):
            values = list(map(self.frequent.get, found))
            left = Counter()
            if None in values:
                left = Counter(p for p, v in zip(found, values) if v is None)
                once.update(p for p in left if p not in self.cache)
                values = [v for v in values if v is not None]
            totals[n] += sum(values)
            rest.append(left)
        fresh = self.encode(sorted(once)) if once else {}
        self.cache.update((p, n) for p, n in fresh.items() if len(p) <= CACHE_LENGTH)
        for n, left in enumerate(rest):
            totals[n] += sum(k * (fresh[p] if p in fresh else self.cache[p]) for p, k in left.items())
        return totals


def frequent_lengths(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of about ``rows`` documents; ``docs`` is (doc_id, text)."""
    whole = docs.count()
    if not whole:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            found: Counter = Counter()
            for raw in texts:
                found.update(p for p in pieces(raw.decode("utf-8", "replace"), path) if len(p) <= CACHE_LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["piece", "n"])

    sample = docs.filter(hash_share(F.col("doc_id"), min(1.0, rows / whole), "frequent"))
    top = (
        sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        .filter("n > 1").orderBy(F.desc("n"), "piece").limit(entries)
    )
    found = [r["piece"] for r in top.collect()]
    return Counts(path, {}).encode(found) if found else {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path`` is a tokenizer file of the tokenizers library with byte-level
    pre-tokens. Counts are those of encoding the whole text without added
    special tokens; special strings in it count as the library has them.
    NULL and empty texts have 0 bytes and tokens. Rows stay rows, also with equal or NULL ids. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(picked, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, shared.value)
        for batch, texts in text_chunks(batches):
            n = np.array(counts.of(texts), dtype=np.int64)
            size = np.array([len(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents`` and the tokenizer byte_bpe_50k.json."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
