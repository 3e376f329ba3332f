"""Substring search for phrase tables of any size.

Every phrase is found by one anchor: a window of its bytes that few phrases and few
texts have. Texts are read once; tasks look for windows that may be anchors with a
bitmap of fixed size and hand on the places found, with as much text around
them as phrases of that anchor need. Places then meet the phrases of their anchor, and what stands
there is compared. No phrase passes the driver, and texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bytes of an anchor; a phrase has one of the first width that is no longer than itself.
WIDTHS = (32, 16, 8, 4, 2, 1)
#: Documents whose windows say how frequent an anchor is. It decides the speed, never the result.
SAMPLE_ROWS = 300
#: Bits of the largest bitmap (8 MB a width); a fuller one only lets more places through.
MOST_BITS = 1 << 26
#: Windows of a phrase that are weighed as its anchor, evenly spaced, and bytes on either side that are compared at once.
TRIED, AROUND = 64, 256
#: Odd numbers that spread windows over the bits; an anchor sets a bit by each. With 32 bits an anchor, one window in 5,000 passes in vain.
SPREADS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
COLUMNS = "doc_id {kind}, width int, anchor long, before binary, after binary"


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """A number for every window of ``width`` bytes: the bytes, first highest, or the numbers of two halves put together."""
    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    if width > 8:
        part = _windows(data, width // 2)
        first, second = part[: len(data) - width + 1], part[width // 2 :]
        return first ^ (second << np.uint64(23) | second >> np.uint64(41))
    out = np.zeros(len(data) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out << np.uint64(8) | data[i : len(data) - width + 1 + i]
    return out


def _window_column(text: Column, start: Column, width: int) -> Column:
    """The same number of the ``width`` bytes of a binary column from ``start`` (0 first)."""
    if width > 8:
        first, second = _window_column(text, start, width // 2), _window_column(text, start + width // 2, width // 2)
        return first.bitwiseXOR(F.shiftleft(second, 23).bitwiseOR(F.shiftrightunsigned(second, 41)))
    return F.conv(F.hex(F.substring(text, start + 1, F.lit(width))), 16, -10).cast("long")


def _slot(windows: np.ndarray, bits: int, spread: int) -> np.ndarray:
    return windows * np.uint64(spread) >> np.uint64(64 - bits.bit_length() + 1)


def anchors(phrases: DataFrame, sample: DataFrame) -> DataFrame:
    """(phrase, body, width, start, anchor) per phrase: the window that the fewest sampled texts and phrases have."""
    size = F.octet_length("body")
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(size >= w, w).otherwise(width)
    sized = phrases.withColumn("width", width)
    step = F.greatest(F.lit(1), F.ceil((size - F.col("width")) / TRIED).cast("int"))
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0), size - F.col("width"), step)))
    number = F.coalesce(*[F.when(F.col("width") == w, _window_column(F.col("body"), F.col("start"), w)) for w in WIDTHS])
    places = written(starts.withColumn("anchor", number), "phrase-windows")
    shared = places.groupBy("width", "anchor").agg(F.count("*").alias("phrases"))
    common = _sampled(sample).join(shared.drop("phrases"), ["width", "anchor"], "left_semi").groupBy("width", "anchor").agg(F.count("*").alias("texts"))
    weighed = places.join(shared, ["width", "anchor"]).join(common, ["width", "anchor"], "left")
    rarest = Window.partitionBy("phrase").orderBy(F.coalesce("texts", F.lit(0)), "phrases", "start")
    return weighed.withColumn("n", F.row_number().over(rarest)).filter("n = 1").select("phrase", "body", "width", "start", "anchor")


def _sampled(sample: DataFrame) -> DataFrame:
    """(width, anchor), a row per sampled text and distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = np.frombuffer(text, dtype=np.uint8)
                for width in WIDTHS:
                    found = np.unique(_windows(data, width)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), width, np.int32)), pa.array(found)], ["width", "anchor"])

    return sample.mapInArrow(run, "width int, anchor long")


class _Bitmap:
    """Windows of one width that may be anchors, and how much text around them is handed on."""

    def __init__(self, chosen: DataFrame, width: int) -> None:
        of_width = chosen.filter(F.col("width") == width)
        n, before, after = of_width.agg(F.count("*"), F.max("start"), F.max(F.octet_length("body") - F.col("start") - width)).first()
        self.before, self.after = min(AROUND, before or 0), min(AROUND, after or 0)
        self.width, self.n = width, n
        self.bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (32 * n).bit_length()))
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        if n:
            self._fill(of_width)

    def _fill(self, of_width: DataFrame) -> None:
        bits = self.bits

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                at = np.concatenate([_slot(keys, bits, spread) for spread in SPREADS])
                marks = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(marks.view(np.int64))], ["slot", "mark"])

        found = of_width.select("anchor").distinct().mapInArrow(marks, "slot long, mark long")
        slots = found.groupBy("slot").agg(F.bit_or("mark").alias("mark")).toArrow()  # at most MOST_BITS / 64 rows
        self.words[slots["slot"].to_numpy()] = slots["mark"].to_numpy().view(np.uint64)

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of the windows that may be anchors."""
        windows = _windows(data, self.width)
        found = np.arange(len(windows))
        for spread in SPREADS:
            at = _slot(windows[found] if len(found) < len(windows) else windows, self.bits, spread)
            found = found[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return found, windows[found].view(np.int64)


def _ragged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between starts and ends as a binary array."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


#: Bytes of surrounding text that a batch of places may hold.
AROUND_BYTES = 32_000_000


def _found_places(texts: DataFrame, maps: list[_Bitmap]) -> DataFrame:
    """(doc_id, width, anchor, before, after) of all places that may be anchors; ``after`` begins with the anchor's bytes."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "width", "anchor", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer(text, dtype=np.uint8)
                for m in maps:
                    places, anchor = m.places(data)
                    if m.width <= 8 and not (m.before or m.after):  # the anchor is the phrase: one place says it all
                        anchor, first = np.unique(anchor, return_index=True)
                        places = places[first]
                    step = max(1, AROUND_BYTES // (m.before + m.after + 1))
                    for at in range(0, len(places), step):
                        p = places[at : at + step]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(np.full(len(p), row))), pa.array(np.full(len(p), m.width, np.int32)), pa.array(anchor[at : at + step]),
                                _ragged(data, np.maximum(p - m.before, 0), p),
                                _ragged(data, p, np.minimum(p + m.width + m.after, len(data))),
                            ],
                            names,
                        )

    return texts.mapInArrow(run, COLUMNS.format(kind=kind))


def phrase_search(docs: DataFrame, phrases: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(phrase, doc_id) of every document (doc_id, text) that contains a phrase of the table, ignoring case.

    NULL and empty phrases ask for nothing; repeated ones ask once, and phrases that differ in case are answered each. NULL and empty texts
    hold nothing. A document is named once per phrase; rows that share an id, NULL among them, are one document. A phrase that
    every text holds costs a row per text and place of its anchor, however many other phrases there are.
    """
    asked = phrases.select(F.col("phrase").cast("string").alias("phrase")).filter("phrase IS NOT NULL AND phrase <> ''").distinct()
    asked = asked.withColumn("body", F.encode(F.lower("phrase"), "UTF-8"))
    texts = docs.select("doc_id", F.encode(F.lower(F.col("text").cast("string")), "UTF-8").alias("body")).filter("octet_length(body) > 0")
    chosen = written(anchors(asked, texts.select("body").limit(sample_rows)), "phrase-anchors")
    maps = [m for m in (_Bitmap(chosen, w) for w in WIDTHS) if m.n]
    near = F.least("start", F.lit(AROUND))
    behind = F.col("start") + F.col("width")
    wanted = chosen.select(
        "phrase", "width", "anchor",
        F.substring("body", F.col("start") - near + 1, near).alias("head"),
        F.substring("body", F.col("start") + 1, F.col("width") + AROUND).alias("tail"),
        ((F.col("start") > AROUND) | (F.octet_length("body") - behind > AROUND)).alias("longer"),
    )
    here = F.endswith("before", "head") & F.startswith("after", "tail")
    places = _found_places(texts, maps).join(wanted, ["width", "anchor"]).filter(here)
    agreed = places.select("phrase", "doc_id", "longer").distinct()
    if not any(m.before == AROUND or m.after == AROUND for m in maps):
        return agreed.select("phrase", "doc_id")
    agreed = written(agreed, "phrase-places")
    open_ones = agreed.filter("longer").select(F.col("doc_id").alias("of"), "phrase")
    whole = docs.select("doc_id", "text").join(open_ones, F.col("doc_id").eqNullSafe(F.col("of"))).filter(F.contains(F.lower("text"), F.lower("phrase")))
    return agreed.filter("NOT longer").select("phrase", "doc_id").unionByName(whole.select("phrase", "doc_id").distinct())
