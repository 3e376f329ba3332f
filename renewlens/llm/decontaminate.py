"""Benchmark decontamination as a prefix-filtered set join.

Every window of ten item words (an item of fewer is one window) is a set of
word shingles. Shingles are ordered by rarity over the whole corpus; to contain
a window a document must hold all of its shingles, so the prefix that the join
needs is the window's rarest one. Documents are searched for prefix shingles
only; length and position bounds drop a candidate whose window would leave the
document, and the rest is verified word by word.

The benchmark side is broadcast in blocks of at most ``BLOCK_WORDS`` words. A
larger benchmark is dealt over more blocks, each of them one more pass, with
the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_chunks

WINDOW = 10
SHINGLE = 4
#: Words of benchmark text that one broadcast index may hold (about 150 bytes each).
BLOCK_WORDS = 400_000

#: Bytes outside a word become blanks, A-Z become a-z; bytes over 127 belong to words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive word numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of one block of items; small enough to broadcast."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.item_ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for n, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            k = min(WINDOW, len(ids))
            for at in range(len(ids) - k + 1 if k else 0):
                found.setdefault(tuple(ids[at : at + k]), set()).add(n)
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        self.words = np.zeros((len(found), WINDOW), dtype=np.int64)
        for n, w in enumerate(found):
            self.words[n, : len(w)] = w
        self.owner_at = np.concatenate(([0], np.cumsum([len(x) for x in found.values()]))).astype(np.int64)
        self.owners = np.array([n for x in found.values() for n in sorted(x)], dtype=np.int64)
        #: shingle sizes in use: windows shorter than a shingle are shingles of their own length
        self.sizes = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        self.shingles = {n: np.unique(self._of(n)[0]) for n in self.sizes}

    def _of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes by window and offset, window numbers) of the windows with this shingle size."""
        rows = np.nonzero(np.minimum(self.length, SHINGLE) == size)[0]
        per = [_rolling(self.words[r, : self.length[r]], size) for r in rows.tolist()]
        wide = max((len(x) for x in per), default=0)
        out = np.array([np.pad(x, (0, wide - len(x)), mode="edge") for x in per], dtype=np.uint64).reshape(len(per), wide)
        return out, rows

    def prefixes(self, frequency: dict[int, np.ndarray]) -> None:
        """Keep of every window its rarest shingle, ties to the earlier one; ``frequency`` is by shingle size."""
        self.prefix = {}
        for size in self.sizes:
            shingles, rows = self._of(size)
            often = frequency[size][np.searchsorted(self.shingles[size], shingles)]
            offset = often.argmin(axis=1)
            key = shingles[np.arange(len(rows)), offset]
            order = np.argsort(key, kind="stable")
            self.prefix[size] = (key[order], rows[order], offset[order])

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in one array (0: not a benchmark word), and the number of words of each text."""
        get, parts, counts = self.vocabulary.get, [], []
        for text in texts:
            found = words(text)
            counts.append(len(found))
            parts.append(np.array([get(w, 0) for w in found], dtype=np.int64))
        return (np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)), np.array(counts, dtype=np.int64)

    def positions(self, ids: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``size`` benchmark words stand together inside one text, and the hash of their shingle."""
        if len(ids) < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        at = np.nonzero(known[size:] - known[:-size] == size)[0]
        at = at[bounds[np.searchsorted(bounds, at, side="right")] >= at + size]
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            out = (out ^ ids[at + k].astype(np.uint64)) * _FACTOR
            out ^= out >> np.uint64(29)
        return at, out

    def count(self, texts: list[bytes], totals: dict[int, np.ndarray]) -> None:
        """Add the occurrences of every benchmark shingle in these texts."""
        ids, counts = self.numbered(texts)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        for size in self.sizes:
            _, hashes = self.positions(ids, bounds, size)
            keys = self.shingles[size]
            slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            totals[size] += np.bincount(slot[keys[slot] == hashes], minlength=len(keys))

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per text, text, start, window) of every window occurrence in these texts."""
        ids, counts = self.numbered(texts)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        starts, windows = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for size in self.sizes:
            keys, rows, offset = self.prefix[size]
            at, hashes = self.positions(ids, bounds, size)
            low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            # a few positions at a time: many windows may share one prefix shingle
            cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 20)[1:]).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(n)]):
                if b <= a:
                    continue
                entry = np.repeat(low[a:b] - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b]) + np.arange(n[a:b].sum())
                place = np.repeat(at[a:b], n[a:b])
                window = rows[entry]
                start = place - offset[entry]
                text = np.searchsorted(bounds, place, side="right") - 1
                # length and position bounds
                fits = (start >= bounds[text]) & (start + self.length[window] <= bounds[text + 1])
                start, window = start[fits], window[fits]
                for k in range(WINDOW):  # verify the whole window
                    longer = self.length[window] > k
                    same = ~longer
                    same[longer] = ids[start[longer] + k] == self.words[window[longer], k]
                    start, window = start[same], window[same]
                starts.append(start)
                windows.append(window)
        start, window = np.concatenate(starts), np.concatenate(windows)
        return counts, np.searchsorted(bounds, start, side="right") - 1, start, window


def _covered(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping [start, end) spans joined into disjoint ones."""
    order = np.lexsort((end, start))
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((np.nonzero(first)[0][1:] - 1, [len(start) - 1]))
    return list(zip(start[first].tolist(), reach[last].tolist()))


RESULT = "mark long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    """Count the block's shingles over all documents, choose prefixes, then search. ``docs`` is (doc_id, mark, text)."""
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = plain.value
        totals = {n: np.zeros(len(index.shingles[n]), dtype=np.int64) for n in index.sizes}
        for _, texts in text_chunks(batches):
            index.count(texts, totals)
        for size, n in totals.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size)), pa.array(at), pa.array(n[at])], ["size", "shingle", "n"]
            )

    counted = docs.select("text").mapInArrow(count, "size long, shingle long, n long")
    frequency = {n: np.zeros(len(index.shingles[n]), dtype=np.int64) for n in index.sizes}
    # at most as many rows as the block has shingles
    for row in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[row["size"]][row["shingle"]] = row["n"]
    index.prefixes(frequency)
    ready = spark.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ready.value
        for batch, texts in text_chunks(batches):
            counts, text, start, window = index.search(texts)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[list[str]] = [[] for _ in texts]
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(len(texts) + 1))
            for n in np.unique(text).tolist():
                own = order[cut[n] : cut[n + 1]]
                begin, hits = start[own] - bounds[n], window[own]
                spans[n] = _covered(begin, begin + index.length[hits])
                owned = [index.owners[index.owner_at[w] : index.owner_at[w + 1]] for w in np.unique(hits).tolist()]
                owners = np.unique(np.concatenate(owned))
                items[n] = [index.item_ids[i] for i in owners.tolist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            spans_col = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], type=kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), spans_col, pa.array(items, type=pa.list_(pa.string()))],
                ["doc_id", "mark", "n_words", "spans", "item_ids"],
            )

    return docs.mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def _merged(spans: Column) -> Column:
    """Disjoint spans from several blocks' spans of one document."""
    step = lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(out, F.array(s)))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, step)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items dealt over blocks of bounded size; only one of them is on the driver at a time."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // (block_words * 4)))
    dealt = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["item_id"], bytes(r["text"])) for r in dealt.filter(F.col("block") == k).toLocalIterator()]


def _joined(passes: list[DataFrame]) -> DataFrame:
    """The passes over several blocks as one. Only rows with hits meet, by id and text hash; equal rows have equal hits."""
    hits = reduce(DataFrame.unionByName, [p.filter(F.size("spans") > 0).distinct() for p in passes])
    merged = hits.groupBy("doc_id", "mark").agg(
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
    )
    rows = passes[0].select("doc_id", "mark", "n_words").alias("r")
    found = merged.alias("m")
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("r.mark").eqNullSafe(F.col("m.mark"))
    none = F.array()
    return rows.join(found, same, "left").select(
        "r.doc_id", "r.mark", "n_words",
        F.coalesce("spans", none.cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("item_ids", none.cast("array<string>")).alias("item_ids"),
    )


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) per row of ``docs``.

    ``spans`` are the disjoint word ranges [start, end) covered by benchmark
    windows, ``item_ids`` the sorted ids, as strings, of items with a window in
    the text. NULL and wordless texts have no words, spans or items; items that
    are NULL, wordless or without an id match nothing; items that repeat an id
    count once. Rows of ``docs`` stay rows, also with equal or NULL ids; other
    columns are not read. Empty tables give no rows, or rows without matches.
    """
    small_batches(docs.sparkSession)
    words_of = F.col(text).cast("string")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(words_of).alias("mark"), words_of.alias("text"))
    items = (
        benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.encode(F.col(item_text), "UTF-8").alias("text"))
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
        .distinct()
    )
    passes = [_pass(picked, Index(block)) for block in _blocks(items, block_words)]
    found = passes[0] if len(passes) == 1 else _joined(passes)
    return found.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """Rows of ``docs`` without a benchmark window, all columns.

    Rows are known by the hash and the length of their text: equal texts have
    equal hits. Those of contaminated rows are written first, so that Spark
    knows their size: texts are shuffled only if they are too many to broadcast.
    """
    key = F.concat_ws(":", F.xxhash64(F.col(text)).cast("string"), F.octet_length(F.col(text)).cast("string"))
    found = find_benchmark(docs.select(key.alias("_key"), F.col(text).alias("_text")), benchmark, "_text", id_col="_key", **more)
    dirty = stored(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.join(dirty, key == F.col("_key"), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents`` against all of ``benchmark``."""
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP8_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win
), place AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, sizes WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, k, item_id FROM place JOIN win USING (k, s)
), per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per USING (doc_id) LEFT JOIN cover USING (doc_id)
"""
