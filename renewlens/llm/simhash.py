"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made row by row. Distinct ones are dealt to the nodes of a
three-level index: a node holds the fingerprints that share one masked bit
pattern. Two fingerprints with at most two differing bits agree in at least one
of three parts of the word, inside the rest again in one of three parts, and so
once more: 27 masks of at least 43 bits cover every link, and a node can hold
at most 2^21 distinct fingerprints however many documents there are. Inside a
node fingerprints stand in Gray order; runs of neighbours are factored into
(mask, pattern) nodes, and a pair of runs is opened only while its accumulated
differences stay within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_chunks
from .components import components

SEED = 42
MAX_BITS = 2
SHINGLE = 3
#: Fingerprints in a run of the Gray order that is factored into one upper node.
RUN = 32


def _thirds(mask: int) -> list[int]:
    """The set bits of a mask dealt into three masks of neighbouring bits."""
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [len(bits) * k // 3 for k in range(4)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def level_masks(levels: int = 3) -> list[int]:
    """Masks of the index nodes: one third is fixed, then a third of the rest, and so on.

    In every level at most two of three thirds hold a differing bit, so a link
    agrees in all bits of at least one mask. The order matters: a link belongs to the first.
    """
    masks = [0]
    for _ in range(levels):
        masks = [m | third for m in masks for third in _thirds(~m & (1 << 64) - 1)]
    return masks


MASKS = level_masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.lower().split()  # bytes: A-Z only, and white space is exactly \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], dtype=np.uint64
        )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp) per row: the hash of the text, and the fingerprint as a signed long. NULL and empty texts have fingerprint 0."""
    small_batches(docs.sparkSession)
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            marks = np.array([_signed(fingerprint(x)) for x in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks)], ["doc_id", "mark", "fp"])

    return picked.mapInArrow(run, "doc_id long, mark long, fp long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _links_between(left: np.ndarray, right: np.ndarray, first: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked fingerprints that belong to this mask: no earlier mask holds both."""
    xor = left[:, None] ^ right[None, :]
    near = np.bitwise_count(xor) <= MAX_BITS
    if same:
        near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(near)
    x = xor[i, j]
    own = np.ones(len(x), dtype=bool)
    for mask in first:
        own &= (x & mask) != 0
    return i[own], j[own]


def _upper_nodes(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) of each run of neighbours: the bits that the whole run shares."""
    at = np.arange(0, len(marks), RUN)
    ones, zeros = np.bitwise_and.reduceat(marks, at), np.bitwise_and.reduceat(~marks, at)
    return ones | zeros, ones


class _Forest:
    """Union-find over positions of one node's fingerprints, so that it hands on a spanning forest only."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for i, j in pairs:
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((i, j))
        return out


def node_links(marks: np.ndarray, level: int) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the links that one index node adds.

    ``marks`` stand in Gray order. Links that an earlier mask holds are left to it.
    """
    first = np.array(MASKS[:level], dtype=np.uint64)
    forest, out = _Forest(len(marks)), []
    mask, pattern = _upper_nodes(marks)
    for a in range(len(mask)):
        left = marks[a * RUN : (a + 1) * RUN]
        # differences that the shared bits of two runs already have; over two, the whole pair of runs goes
        open_ = a + np.nonzero(np.bitwise_count((pattern[a] ^ pattern[a:]) & mask[a] & mask[a:]) <= MAX_BITS)[0]
        # then the run's pattern against single fingerprints of the runs that are left
        for b in open_.tolist():
            right = marks[b * RUN : (b + 1) * RUN]
            keep = np.nonzero(np.bitwise_count((pattern[a] ^ right) & mask[a]) <= MAX_BITS)[0]
            if b == a:
                keep = np.arange(len(right))
            if not len(keep):
                continue
            i, j = _links_between(left, right[keep], first, a == b)
            out += forest.join(zip((a * RUN + i).tolist(), (b * RUN + keep[j]).tolist()))
    return out


def _streamed_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the nodes of a partition; rows come sorted by level, pattern and Gray rank."""
    masks = np.array(MASKS, dtype=np.uint64)
    rest_level, rest = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint64)

    def links(level: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s > 1:
                for i, j in node_links(marks[s:e], int(level[s])):
                    left.append(s + i)
                    right.append(s + j)
        ab = [marks[np.array(x, dtype=np.int64)].view(np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ab], ["a", "b"])

    for batch in batches:
        level = np.concatenate((rest_level, batch.column(0).to_numpy(zero_copy_only=False)))
        marks = np.concatenate((rest, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(marks):
            continue
        key = marks & masks[level]
        cut = np.concatenate(([0], 1 + np.nonzero((key[1:] != key[:-1]) | (level[1:] != level[:-1]))[0]))
        yield links(level, marks, cut[:-1], cut[1:])
        rest_level, rest = level[cut[-1] :], marks[cut[-1] :]  # the last node may go on in the next batch
    if len(rest):
        yield links(rest_level, rest, np.array([0]), np.array([len(rest)]))


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two fingerprints with at most two differing bits.

    ``marks`` has distinct values in ``fp``. Rows are a spanning forest per
    index node: no link between components is lost, and a group of k
    fingerprints gives about k rows, not k squared.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in MASKS])
    leveled = marks.select(F.explode(F.sequence(F.lit(0), F.lit(len(MASKS) - 1))).alias("level"), "fp")
    pattern = F.col("fp").bitwiseAND(F.element_at(masks, F.col("level") + 1))
    # rank in the Gray sequence: prefix parity of the bits
    rank = F.col("fp")
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return (
        leveled.repartition("level", pattern)
        .sortWithinPartitions("level", pattern, rank)
        .mapInArrow(_streamed_nodes, "a long, b long")
    )


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp, root, component_id) per row of ``docs``, by SimHash distance of at most two bits.

    Input: any table with an id and a text column; other columns, whatever
    their names, are not read. ``component_id`` is the smallest id reachable
    over links; ``root`` is a fingerprint that names the component.
    Texts that are NULL, empty or blank have fingerprint 0 and link like any
    other. Rows with equal ids or equal texts are rows of their own. A NULL id
    links as well, but never is a component id unless a component has no other
    (then it is NULL). An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs, text, id_col), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(classes.select("fp")), "simhash-links")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = stored(named, "simhash-classes")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(smallest, "root"), "fp").select(
        "doc_id", "mark", "fp", "root", "component_id"
    )


def one_per_group(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of every near-duplicate group: that of its smallest id.

    All columns are kept. Rows are known by their id and the hash of their text.
    Of rows that repeat the smallest id of their group one stays, that with the
    smallest hash; a group without any id keeps one row the same way. What goes
    is written first, so that Spark knows its size: texts are shuffled only if it is too large to broadcast.
    """
    mark = F.xxhash64(F.col(text))
    found = near_duplicates(docs, text, id_col)
    gone = stored(
        found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "simhash-gone"
    )
    named = docs.filter(F.col(id_col).isNotNull())
    out = named.join(gone, (F.col(id_col).cast("long") == F.col("_id")) & (mark == F.col("_mark")), "left_anti")
    least = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "root")
    again = stored(
        least.groupBy("root", "_id").agg(F.count("*").alias("n"), F.min("_mark").alias("_first")).filter("n > 1").drop("n"), "simhash-again"
    )
    if not again.isEmpty():
        # an id may be the smallest of several groups, each of which keeps a row of its own
        repeats = stored(
            least.join(again, ["root", "_id"]).select("_id", "_mark", (F.col("_mark") == F.col("_first")).alias("_stays")).distinct(),
            "simhash-repeats",
        )
        same = (F.col(id_col).cast("long") == F.col("_id")) & (mark == F.col("_mark"))
        turn = Window.partitionBy(F.col(id_col).cast("long"), mark).orderBy(F.length(F.col(text)))
        once = out.join(repeats.filter("_stays"), same, "left_semi").withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").drop("_turn")
        out = out.join(repeats, same, "left_anti").unionByName(once)
    nameless = docs.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return out
    first = Window.partitionBy("root").orderBy("mark")
    left = stored(
        found.filter("component_id IS NULL").withColumn("_turn", F.row_number().over(first)).filter("_turn = 1")
        .select(F.col("mark").alias("_mark")), "simhash-nameless",
    )
    by_mark = Window.partitionBy(mark).orderBy(F.length(F.col(text)))
    kept = nameless.join(left, mark == F.col("_mark"), "left_semi").withColumn("_turn", F.row_number().over(by_mark))
    return out.unionByName(kept.filter("_turn = 1").drop("_turn"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
