"""Near-duplicate embeddings through randomised-rotation binary codes.

Exact copies become one class. Every class vector is rotated by seeded random
rotations; the signs are its codes, and the inner product of the code with the vector is the
stored correction factor. Bands of code bits are hash tables: classes that share a band, and the label, are compared.
For a pair, code times rotated vector over the factor is an unbiased estimate of the cosine; if its upper
confidence bound stays below the threshold the pair is dropped, else the cosine is computed exactly in double precision.

A pair counts in the first table that holds it, so links are counted without being listed: a task hands on the
sum of links per class and a spanning forest. Tables' buckets beyond ``SPLIT`` classes are dealt over block pairs.
At cosine 0.98 a code bit differs with probability 0.064, a band of 16 bits agrees with probability 0.35, and
all 20 tables miss a pair with probability 0.0002; closer pairs are missed less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

THRESHOLD = 0.98
BAND_BITS, BANDS, TABLES = 16, 4, 20
#: Standard errors of an estimate that a dropped pair must lie below the threshold.
SURE = 5.0
#: Classes of a bucket that one task compares; larger buckets are dealt over block pairs.
SPLIT = 2_048
BLOCK = 512
SEED = 20


@cache
def rotations(dim: int) -> np.ndarray:
    """Random rotations of a dimension, the same in every worker: as many as give TABLES bands."""
    per = bands_of(dim)[0]
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-TABLES // per))])


def bands_of(dim: int) -> tuple[int, int]:
    """(bands per code, bits per band)."""
    bits = min(BAND_BITS, dim)
    return max(1, min(BANDS, dim // bits)), bits


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, signs, factors) of unit vectors: rotation by vector by dimension; factors by rotation and vector."""
    rotated = np.einsum("rij,nj->rni", rotations(unit.shape[1]), unit)
    signs = rotated > 0
    return rotated, signs, np.abs(rotated).sum(axis=2) / np.sqrt(unit.shape[1])


def bands(signs: np.ndarray) -> np.ndarray:
    """Band values, vector by table."""
    per, bits = bands_of(signs.shape[2])
    weight = 1 << np.arange(bits, dtype=np.int64)
    cut = signs[:, :, : per * bits].reshape(signs.shape[0], signs.shape[1], per, bits) @ weight
    return cut.transpose(1, 0, 2).reshape(signs.shape[1], -1)[:, :TABLES].astype(np.int32)


def _unit(vec: np.ndarray) -> np.ndarray:
    scaled = vec / np.abs(vec).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vec): components as bytes in their own precision, NULL if the vector cannot be compared."""
    for batch in batches:
        column = batch.column(2)
        out: list[bytes | None] = [None] * batch.num_rows
        if batch.num_rows:
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)  # NULL becomes NaN
            usable = ~(column.is_null().to_numpy(zero_copy_only=False) | batch.column(1).is_null().to_numpy(zero_copy_only=False))
            usable &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for n in np.nonzero(usable & (np.diff(offsets) > 0))[0].tolist():
                one = values[offsets[n] : offsets[n + 1]] + values.dtype.type(0)  # no negative zero
                if np.isfinite(one).all() and one.any():
                    out[n] = one.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.binary())], ["vec_id", "label", "vec"])


def _doubles(vecs: list[bytes], single: bool) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(vecs), dtype=np.float32 if single else np.float64).reshape(len(vecs), -1).astype(np.float64)


def _indexed(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Adds the codes, factors and band values of each class."""
    for batch in batches:
        vecs = batch.column(batch.schema.get_field_index("vec")).to_pylist()
        sizes = np.array([len(v) for v in vecs])
        for size in np.unique(sizes).tolist():
            at = np.nonzero(sizes == size)[0]
            mat = _doubles([vecs[n] for n in at.tolist()], single)
            _, signs, factors = codes(_unit(mat))
            packed = np.packbits(signs, axis=2).transpose(1, 0, 2).reshape(len(at), -1)
            columns = [c.take(pa.array(at)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array([x.tobytes() for x in packed], type=pa.binary()),
                    pa.array([x.tobytes() for x in factors.T.astype(np.float32)], type=pa.binary()),
                    pa.array(bands(signs).tolist(), type=pa.list_(pa.int32())),
                ],
                [*batch.schema.names, "codes", "factors", "bands"],
            )


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the links (i, j), for positions 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Bucket:
    """The classes of one block pair of one bucket."""

    def __init__(self, table_no: int, vec: np.ndarray, packed: np.ndarray, factors: np.ndarray, size: np.ndarray, part: np.ndarray, halves: bool) -> None:
        self.table, self.size, self.part, self.halves = table_no, size, part, halves
        self.dim = vec.shape[1]
        self.vec = _unit(vec)
        count = len(rotations(self.dim))
        bits = np.unpackbits(packed.reshape(len(vec), count, -1), axis=2, count=self.dim).transpose(1, 0, 2).astype(bool)
        self.bands = bands(bits)
        self.signs = bits * np.float32(2) - np.float32(1)
        self.factors = factors
        self.rotated = np.einsum("rij,nj->rni", rotations(self.dim), self.vec).astype(np.float32)

    def may_link(self, a: slice, b: slice) -> np.ndarray:
        """Pairs whose estimated cosine is not surely below the threshold."""
        total, count = 0.0, len(self.signs)
        for signs, rotated, factor in zip(self.signs, self.rotated, self.factors.T):
            total = total + (signs[a] @ rotated[b].T) / (np.sqrt(self.dim) * factor[a, None])
        spread = np.sqrt(np.maximum(1 - self.factors[a] ** 2, 0) / self.factors[a] ** 2).mean(axis=1)
        error = spread / np.sqrt(max(1, self.dim - 1) * count)
        return total / count + SURE * error[:, None] + 1e-4 >= THRESHOLD

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links per class counted with copies, i, j): a spanning forest of the links that this table adds."""
        n = len(self.vec)
        degree, ends = np.zeros(n, dtype=np.int64), []
        for s in range(0, n, BLOCK):
            for t in range(s, n, BLOCK):
                a, b = slice(s, s + BLOCK), slice(t, t + BLOCK)
                open_ = self.may_link(a, b)
                if s == t:
                    open_ &= np.triu(np.ones(open_.shape, dtype=bool), 1)
                if self.halves:
                    open_ &= self.part[a, None] != self.part[None, b]
                if not open_.any():
                    continue
                for earlier in range(self.table):  # the first table that holds a pair counts it
                    open_ &= self.bands[a, None, earlier] != self.bands[None, b, earlier]
                i, j = np.nonzero(open_)
                if len(i) > open_.size // 20:
                    cosine = (self.vec[a] @ self.vec[b].T)[i, j]
                else:
                    cosine = np.einsum("nd,nd->n", self.vec[a][i], self.vec[b][j])
                linked = cosine >= THRESHOLD
                i, j = s + i[linked], t + j[linked]
                degree += np.bincount(i, weights=self.size[j], minlength=n).astype(np.int64)
                degree += np.bincount(j, weights=self.size[i], minlength=n).astype(np.int64)
                # within the block pair the forest is enough
                label = forest(n, i, j) if len(i) else np.arange(n)
                moved = np.nonzero(label != np.arange(n))[0]
                ends.append((moved, label[moved]))
        i, j = (np.concatenate([e[k] for e in ends]) if ends else np.empty(0, dtype=np.int64) for k in (0, 1))
        return degree, i, j


_KEY = ["t", "label", "dim", "band", "low", "high"]


def _compared(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition, whose rows come sorted by bucket and block pair."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        first = {k: rows[k][0].as_py() for k in ("t", "dim", "low", "high")}
        matrix = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), dtype=kind).reshape(rows.num_rows, -1)
        rep, mark = (rows[k].to_numpy() for k in ("rep", "mark"))
        bucket = Bucket(
            first["t"], _doubles(rows["vec"].to_pylist(), single), matrix("codes", np.uint8), matrix("factors", np.float32),
            rows["size"].to_numpy(), rows["part"].to_numpy(), first["low"] != first["high"],
        )
        degree, i, j = bucket.links()
        has = np.nonzero(degree)[0]
        columns = [
            pa.array(np.concatenate((rep[has], rep[i]))),
            pa.array(np.concatenate((mark[has], mark[i]))),
            pa.array([None] * len(has) + rep[j].tolist(), type=pa.int64()),
            pa.array(np.concatenate((degree[has], np.zeros(len(i), dtype=np.int64)))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["rep", "mark", "other", "n"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None or not held.num_rows else pa.concat_tables([held, rows])
        if not held.num_rows:
            continue
        new = np.zeros(held.num_rows, dtype=bool)
        for k in _KEY:
            values = held[k].combine_chunks()
            values = values.dictionary_encode().indices.to_numpy() if pa.types.is_string(values.type) else values.to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cut = [0, *np.nonzero(new)[0].tolist()]
        for a, b in zip(cut, cut[1:]):  # the last bucket may go on in the next batch
            if b - a > 1:
                yield one(held.slice(a, b - a))
        held = held.slice(cut[-1]).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield one(held)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", split: int = SPLIT
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors with equal, non-NULL labels and equal dimension link at a cosine of
    0.98 or more. Vectors that are NULL, empty or zero, or hold NULL or
    non-finite components, and rows with a NULL id or label, link with nothing: no links, their own id
    as component. Equal vectors are linked copies, also under one id; rows that repeat an id
    are counted as rows and share a component. Extra columns are not read; an empty table gives an empty table.
    """
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    picked = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("embedding"),
    )
    rows = stored(
        picked.mapInArrow(_vectors, "vec_id long, label string, vec binary").withColumn("mark", F.xxhash64("label", "vec")), "vectors"
    )
    usable = rows.filter("vec IS NOT NULL")
    classes = usable.groupBy("label", "vec", "mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    schema = "label string, vec binary, mark long, rep long, size long, codes binary, factors binary, bands array<int>"
    index = stored(classes.mapInArrow(lambda batches: _indexed(batches, single), schema), "vector-index").withColumn("dim", F.octet_length("vec"))

    key = ["t", "label", "dim", "band"]
    large = stored(
        index.select("label", "dim", F.posexplode("bands").alias("t", "band")).groupBy(*key)
        .agg(F.count("*").alias("n")).filter(F.col("n") > split), "vector-buckets",
    )
    dealt = index.select("*", F.posexplode("bands").alias("t", "band")).drop("bands").join(large, key, "left")
    parts = F.coalesce(F.ceil(F.col("n") / split), F.lit(1)).cast("int")
    dealt = (
        dealt.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep", "mark", F.lit("part")), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .select(*_KEY, "rep", "mark", "size", "part", "vec", "codes", "factors")
    )
    found = stored(
        dealt.repartition(*_KEY).sortWithinPartitions(*_KEY)
        .mapInArrow(lambda batches: _compared(batches, single), "rep long, mark long, other long, n long"), "vector-links"
    )
    degrees = found.groupBy("rep", "mark").agg(F.sum("n").alias("near"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), "vector-components")
    named = (
        index.select("label", "vec", "mark", "rep", "size")
        .join(degrees, ["rep", "mark"], "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", "mark", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    return rows.join(named, ["mark", "label", "vec"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""
