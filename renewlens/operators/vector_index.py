"""Vector search by an index: centroid buckets as a written table, several buckets probed per query, exact re-ranking.

The index is a folder: ``vectors`` holds every vector under the bucket of its
nearest centroid (one parquet partition per bucket), ``centroids`` the bucket
centres, written last, so that a folder is only opened when it is whole. A search
reads the partitions that its queries probe and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .customer360 import top_per_key
from .search import BROADCAST_VECTORS, LIMIT, _batch_best, _unit, vector_search

#: Centroids are fitted on a sample of about this many vectors, or SAMPLE_PER_BUCKET for every bucket; all vectors are indexed.
SAMPLE, SAMPLE_PER_BUCKET = 20_000, 16
#: Buckets grow with the root of the number of vectors up to this; centroids go to every task.
MOST_BUCKETS = 4_096
ROUNDS = 10
#: Share of true neighbours that the default number of probes finds on the sample, and queries it is measured with.
RECALL, TRIED = 0.95, 256
#: Vectors of one bucket that meet a block of queries in one task when queries are too many to broadcast.
SLICE = 20_000


@dataclass(frozen=True)
class VectorIndex:
    """An opened index: where it lies, its centroids (one row per bucket) and how many buckets a query probes."""

    spark: SparkSession
    folder: str
    centroids: np.ndarray
    probes: int
    schema: str

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/vectors")

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of every unit vector, nearest first."""
        return nearest(units, self.centroids, n)


#: Similarities of rows and centroids that are held at a time.
NEAREST_CELLS = 1 << 20


def nearest(units: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Places of the ``n`` nearest centroids of every row, in blocks of rows that are the smaller the more centroids there are."""
    if len(centroids) == 1:
        return np.zeros((len(units), 1), dtype=np.int64)
    found, block = np.empty((len(units), min(n, len(centroids))), dtype=np.int64), max(1, NEAREST_CELLS // len(centroids))
    for at in range(0, len(units), block):
        scores = units[at : at + block] @ centroids.T
        found[at : at + block] = scores.argmax(axis=1)[:, None] if n == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :n]
    return found


def fit_centroids(units: np.ndarray, buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows, empty buckets take the rows furthest from their centres."""
    centroids = units[np.linspace(0, len(units) - 1, buckets).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(units, centroids)[:, 0]
        fit = np.einsum("ij,ij->i", units, centroids[own])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        empty = np.flatnonzero(np.bincount(own, minlength=buckets) == 0)
        sums[empty] = units[np.argsort(fit, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.divide(sums, norms, out=centroids, where=norms > 0)
    return centroids


def needed_probes(units: np.ndarray, centroids: np.ndarray, recall: float, k: int = LIMIT) -> int:
    """The smallest number of probes that finds a share ``recall`` of the ``k`` nearest rows of some rows of the sample."""
    asked = np.linspace(0, len(units) - 1, min(TRIED, len(units))).astype(int)
    own = nearest(units, centroids)[:, 0]
    order = nearest(units[asked], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), axis=0), axis=1)
    scores = units[asked] @ units.T
    best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]  # the row itself, and k others
    at = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def _schema(vectors: DataFrame) -> str:
    """The columns of the written vectors."""
    return ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "embedding")) + ", bucket int"


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(bucket=nearest(_unit(batch["embedding"]), shared.value)[:, 0].astype("int32"))

    return vectors.mapInPandas(assign, _schema(vectors))


def _write(vectors: DataFrame, centroids: np.ndarray, folder: str, mode: str) -> None:
    """Vectors under their buckets. Rebalancing splits the rows of a bucket that holds very many over several tasks and files."""
    dealt = _assigned(vectors, centroids).hint("rebalance", "bucket")
    dealt.write.mode(mode).partitionBy("bucket").parquet(f"{folder}/vectors")


def _present(corpus: DataFrame) -> DataFrame:
    return corpus.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")


def build_index(
    corpus: DataFrame, folder: str, buckets: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = LIMIT
) -> VectorIndex:
    """Index all of ``corpus`` (vec_id, embedding) below ``folder``, which must be new.

    Vectors or ids that are NULL are left out. ``buckets`` defaults to the root of the number of vectors. Centroids
    are fitted on about ``sample`` vectors, chosen by the hash of their ids, and the default
    number of probes is the smallest that finds the share ``recall`` of the ``k`` nearest neighbours there; the whole
    corpus is denser, so its neighbours are nearer and not harder to find. An empty corpus gives an empty index.
    """
    spark = corpus.sparkSession
    vectors = _present(corpus)
    rows = vectors.count()
    buckets = max(1, min(buckets or round(rows**0.5), MOST_BUCKETS, rows or 1))
    share = min(1.0, max(sample, SAMPLE_PER_BUCKET * buckets) / max(1, rows))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit("centroids")), F.lit(1 << 50)) < int(share * (1 << 50)))
    units = _unit(chosen.select("embedding").toPandas()["embedding"]) if rows else np.zeros((0, 1))
    if not len(units):
        units = np.zeros((1, 1)) if not rows else _unit(vectors.select("embedding").limit(1).toPandas()["embedding"])
    centroids = fit_centroids(units, min(buckets, len(units)))
    probes = needed_probes(units, centroids, recall, k)
    _write(vectors, centroids, folder, "error")
    schema = _schema(vectors)
    table = [(i, [float(x) for x in row], probes, schema) for i, row in enumerate(centroids)]
    columns = "bucket int, centroid array<double>, probes int, columns string"
    spark.createDataFrame(table, columns).coalesce(1).write.parquet(f"{folder}/centroids")
    return VectorIndex(spark, folder, centroids, probes, schema)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """The index below ``folder``; an error if its building did not come to its end."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("bucket").collect()
    return VectorIndex(spark, folder, np.array([r["centroid"] for r in rows]), rows[0]["probes"], rows[0]["columns"])


def add_vectors(index: VectorIndex, more: DataFrame) -> None:
    """Append vectors to the buckets of an index; its centroids stay. Ids are not checked against those already there."""
    _write(_present(more), index.centroids, index.folder, "append")


def search_index(
    index: VectorIndex, queries: DataFrame, k: int = LIMIT, probes: int | None = None, broadcast_vectors: int | None = None
) -> DataFrame:
    """Cosine top ``k`` per query (query_id, embedding) among the vectors of its ``probes`` nearest buckets.

    Columns and rounding are those of ``vector_search``; the similarities are exact, and with all
    buckets probed so are the rows. Queries of up to ``broadcast_vectors`` go to every task and the index is not shuffled; more of them meet slices of
    their buckets. NULL queries are not asked.
    """
    most = BROADCAST_VECTORS if broadcast_vectors is None else broadcast_vectors
    n = max(1, min(probes or index.probes, len(index.centroids)))
    queries = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    vectors = index.vectors()
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, cosine_similarity double"
    head = queries.limit(most + 1).toPandas()
    if len(head) <= most:
        best = _broadcast_search(index, vectors, head, k, n, schema)
    else:
        best = _dealt_search(index, vectors, queries, k, n, schema, max(1, most))
    order = [F.desc("cosine_similarity"), F.asc("vec_id")]
    return top_per_key(best, ["query_id"], order, k, rank="rank").select("query_id", "rank", "vec_id", "cosine_similarity")


def _broadcast_search(index: VectorIndex, vectors: DataFrame, head: pd.DataFrame, k: int, n: int, schema: str) -> DataFrame:
    ids = head["query_id"].to_numpy()
    units = _unit(head["embedding"]) if len(head) else np.zeros((0, index.centroids.shape[1]))
    probed = index.nearest(units, n)
    asking = {int(b): np.flatnonzero((probed == b).any(axis=1)) for b in np.unique(probed)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, rows in batch.groupby("bucket", sort=False):
                q = asking[int(bucket)]
                yield _batch_best(rows["vec_id"].to_numpy(), _unit(rows["embedding"]), ids[q], units[q], k)

    # the buckets are constants of the plan (at most MOST_BUCKETS), so that only their partitions are listed and read
    return vectors.filter(F.col("bucket").isin(sorted(asking))).mapInPandas(score, schema)


def _dealt_search(
    index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, n: int, schema: str, block: int
) -> DataFrame:
    """Queries too many to broadcast: every (bucket, slice, block) cell compares a slice of a bucket with a block of its queries."""
    kind, inner = queries.schema["query_id"].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = nearest(_unit(batch["embedding"]), shared.value, n)
                yield batch.assign(buckets=list(found.astype("int32")))

    # queries are repeated per bucket by Spark, row by row: a task's Python holds each of them once
    asked = queries.mapInPandas(probe, f"query_id {kind}, embedding {inner}, buckets array<int>").select(
        "query_id", "embedding", F.explode("buckets").alias("bucket")
    )
    blocks = asked.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    slices = vectors.groupBy("bucket").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    cells = F.broadcast(blocks.join(slices, "bucket"))  # a row per bucket
    count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = vectors.join(cells, "bucket").select(
        "vec_id", "embedding", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"), count("blocks").alias("block")
    )
    right = asked.join(cells, "bucket").select(
        "query_id", "embedding", "bucket", count("slices").alias("slice"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    )

    def cell(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if held.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine_similarity": []})
        return _batch_best(
            held["vec_id"].to_numpy(), _unit(held["embedding"]), wanted["query_id"].to_numpy(), _unit(wanted["embedding"]), k
        )

    key = ["bucket", "slice", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(cell, schema)


def measured_recall(corpus: DataFrame, queries: DataFrame, found: DataFrame, k: int = LIMIT, tried: int = TRIED) -> tuple[float, bool]:
    """(share of true neighbours found, whether their similarities are exact), by brute force for ``tried`` queries chosen by hash.

    The number of queries is fixed, so the cost grows with the corpus alone.
    """
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(tried)
    exact = vector_search(corpus, some, k).withColumnRenamed("cosine_similarity", "exact")
    both = exact.join(found.drop("rank"), ["query_id", "vec_id"], "left")
    same = F.col("cosine_similarity") == F.col("exact")
    row = both.agg(F.count("*"), F.count("cosine_similarity"), F.coalesce(F.every(same), F.lit(True))).first()
    return (row[1] / row[0] if row[0] else 1.0), row[2]
