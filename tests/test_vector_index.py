"""The vector index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.operators import vector_index as vi
from renewlens.operators.search import vector_search
from renewlens.session import shared_folder

SF_DIR = "/root/testdata/sf0.01"


def frame(spark, matrix, start=0, name="vec_id"):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def clouds():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    return (centres[draw.integers(0, 12, 900)] + 0.35 * draw.normal(size=(900, 16))).astype("float32")


@pytest.fixture(scope="module")
def index(spark, clouds):
    return vi.build_index(frame(spark, clouds).repartition(3), shared_folder(spark, "index"), buckets=24)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def probed(df):
    """Buckets named in the partition filter of the scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_few_buckets_are_read_and_most_neighbours_found(spark, clouds, index):
    asked = frame(spark, clouds[:40], name="query_id")
    found = vi.search_index(index, asked)
    recall, exact = vi.measured_recall(frame(spark, clouds), asked, found)
    assert recall >= 0.9 and exact and index.probes < 12
    one = vi.search_index(index, frame(spark, clouds[:1], name="query_id"), probes=2)
    wanted = {int(b) for b in index.nearest(clouds[:1] / np.linalg.norm(clouds[:1]), 2)[0]}
    assert all(f"{b}" in probed(one) for b in wanted) and "bucket" in probed(one)
    files = {f.split("bucket=")[1].split("/")[0] for f in index.vectors().filter(F.col("bucket").isin(sorted(wanted))).inputFiles()}
    assert {int(f) for f in files} <= wanted | set(range(24)) and one.count() == 5


def test_all_buckets_give_the_exact_rows(spark, clouds, index):
    asked = frame(spark, clouds[100:130], name="query_id")
    exact = rows(vector_search(frame(spark, clouds), asked))
    assert rows(vi.search_index(index, asked, probes=24)) == exact
    assert rows(vi.search_index(index, asked, probes=24, broadcast_vectors=4)) == exact


def test_both_plans_find_the_same(spark, clouds, index, monkeypatch):
    monkeypatch.setattr(vi, "SLICE", 20)
    asked = frame(spark, clouds[:50], name="query_id")
    assert rows(vi.search_index(index, asked, probes=3, broadcast_vectors=7)) == rows(vi.search_index(index, asked, probes=3))


def test_every_row_is_indexed_and_more_can_be_added(spark, clouds):
    folder = shared_folder(spark, "index")
    first = vi.build_index(frame(spark, clouds[:500]), folder, sample=50)
    assert first.vectors().count() == 500
    vi.add_vectors(first, frame(spark, clouds[500:], 500))
    opened = vi.open_index(spark, folder)
    assert opened.probes == first.probes and np.allclose(opened.centroids, first.centroids)
    asked = frame(spark, clouds[890:], name="query_id")
    assert rows(vi.search_index(opened, asked, probes=10**6)) == rows(vector_search(frame(spark, clouds), asked))


def test_a_hot_bucket_is_split(spark, monkeypatch):
    """A third of all vectors are equal; rebalancing may write them to several files, and all are found."""
    matrix = np.vstack([np.ones((200, 8)), np.random.default_rng(1).normal(size=(400, 8))]).astype("float32")
    index = vi.build_index(frame(spark, matrix).repartition(4), shared_folder(spark, "index"), buckets=8)
    assert index.vectors().count() == 600
    asked = frame(spark, matrix[:1], name="query_id")
    assert [r[2:] for r in rows(vi.search_index(index, asked, k=3))] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0]), (4, [0.0, 2.0])]
    corpus = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("bucket", F.lit("x"))
    index = vi.build_index(corpus, shared_folder(spark, "index"))
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id long, embedding array<float>")
    assert rows(vi.search_index(index, asked, probes=9)) == [(7, 1, 4, 1.0), (7, 2, 4, 1.0), (7, 3, 1, 0.0), (7, 4, 3, 0.0)]
    assert vi.search_index(index, asked.limit(0)).count() == 0


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vi.build_index(none, shared_folder(spark, "index"))
    assert vi.search_index(index, spark.createDataFrame([(7, [0.5])], "query_id long, embedding array<float>")).count() == 0


def test_an_unfinished_index_is_not_opened(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        vi.open_index(spark, str(tmp_path / "nothing"))
