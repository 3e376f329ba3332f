"""What a task holds, reads or hands on does not grow faster than the input."""

from __future__ import annotations

import datetime as dt
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from renewlens.operators import decide, search, topk
from renewlens.operators import interactions as ix
from renewlens.operators.customer360 import spread_keys
from renewlens.operators.vector_index import nearest
from renewlens.plans import catalogue
from renewlens.streaming import alerts

DOCS = [
    (1, "Flood raised the premium. The premium rose! Rare words? - - . Flood, flood premium"), (2, ""), (3, None), (4, "one line"),
    (5, "Twice given. Twice again."), (5, "Twice given, and more. Again twice twice."), (None, "no id here. no id"), (None, "no id either"),
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_texts_of_one_row_are_summed_up_in_their_rows(spark):
    turns = texts(spark).select(F.col("doc_id").alias("interaction_id"), F.lit(0).cast("long").alias("turn_no"), F.lit("Customer").alias("speaker"), "text")
    rows = lambda df: sorted(map(str, df.select("interaction_id", "turn_no", "sentence_no", "sentence", "score").collect()))
    for n in (1, 2, 3):
        assert rows(ix.summary_sentences(turns, n, one_row_each=True)) == rows(ix.summary_sentences(turns, n))
    assert "Exchange" not in plan(ix.summary_sentences(turns.filter("interaction_id < 5"), one_row_each=True))


def test_words_are_counted_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr("renewlens.functions.counting.PIECE_WORDS", 2)
    rows = sorted((r.doc_id or 0, r.word, r.length, r.tf) for r in search.build_postings(texts(spark), anchored=True).collect())
    assert rows[:5] == [(0, "", 5, 2), (0, "either", 3, 1), (0, "here", 5, 1), (0, "id", 5, 3), (0, "no", 5, 3)]
    assert (2, "", 0, 1) in rows and not [r for r in rows if r[0] == 3] and (5, "twice", 7, 5) in rows
    assert sorted((w, tf) for d, w, _, tf in rows if d == 1) == [("", 1), ("flood", 3), ("premium", 3), ("raised", 1), ("rare", 1), ("rose", 1), ("the", 2), ("words", 1)]
    text = plan(search.build_postings(texts(spark), anchored=True, unique=True))
    assert "Exchange" not in text and "Aggregate" not in text


def test_tasks_grow_with_the_pairs_they_score(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "flood premium"), (2, "twice"), (3, "line")], "query_id long, text string")
    docs = texts(spark).filter("doc_id IS NOT NULL")
    before = sorted(map(str, search.text_search(docs, queries).collect()))
    monkeypatch.setattr(search, "TASK_PAIRS", 1)
    found = search.text_search(docs, queries)
    assert "13), REPARTITION_BY_NUM" in plan(found)  # four documents, three queries
    assert sorted(map(str, found.collect())) == before


def test_many_query_words_score_no_document_in_vain(spark, monkeypatch):
    kept = []
    written = topk.written
    monkeypatch.setattr(topk, "written", lambda df, purpose: kept.append((purpose, written(df, purpose))) or kept[-1][1])
    docs = texts(spark, [(i, f"flood {'premium ' * (i % 50)}{'other ' * (i % 7)}") for i in range(400)])
    queries = spark.createDataFrame([(1, "flood premium"), (2, "premium")], "query_id long, text string")
    shuffled = sorted(map(str, search.text_search(docs, queries, broadcast_rows=1).collect()))
    assert dict(kept)["candidates"].count() < 400
    assert shuffled == sorted(map(str, search.text_search(docs, queries).collect()))


def test_a_micro_batch_is_written_by_several_tasks(spark):
    seen = []

    class Done:
        def awaitTermination(self):
            pass

    def feed(arriving):
        seen.append(len(arriving.sparkSession.read.parquet(folder[0]).inputFiles()))
        return Done()

    folder = []
    shared = catalogue.shared_folder
    catalogue.shared_folder = lambda *a: folder.append(shared(*a)) or folder[-1]
    try:
        catalogue._stream(spark, spark.range(300).repartition(4), "id", feed)
    finally:
        catalogue.shared_folder = shared
    assert seen == [4, 8, 12]


def test_a_repeated_key_has_a_part_per_so_many_rows(spark):
    right = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(3)] + [("c", 1), (None, 2)], "k string, v int")
    assert sorted(map(tuple, spread_keys(right, "k", 2).collect())) == [("a", 5), ("b", 2)]
    assert [r.parts for r in spread_keys(spark.range(500).select(F.lit(1).alias("k")), "k", 1).collect()] == [64]


def test_nearest_centroids_are_found_in_small_blocks():
    draw = np.random.default_rng(1)
    units, centroids = draw.normal(size=(2_000, 8)), draw.normal(size=(4_000, 8))
    tracemalloc.start()
    one, three = nearest(units, centroids), nearest(units, centroids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = np.argsort(-(units[:50] @ centroids.T), axis=1, kind="stable")
    assert (three[:50] == expected[:, :3]).all() and (one[:50] == expected[:, :1]).all() and three.shape == (2_000, 3)
    assert peak < 48e6


def test_rows_without_a_key_are_spread(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(1_000).select(F.col("id").alias("customer_id"), F.when(F.col("id") < 10, F.col("id")).alias("k"))
        right = spark.createDataFrame([(i, i * 2) for i in range(5)] + [(None, 7)], "k long, v long")
        rows = decide.join_known(left, right, "k", "customer_id").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.customer_id, r.k, r.v) for r in rows if r.v is not None) == [(i, i, i * 2) for i in range(5)] and len(rows) == 1_000
    assert len({r.task for r in rows if r.k is None}) > 1


def test_two_assessments_per_property_of_a_batch():
    day = dt.date(2025, 1, 1)
    rows = [("a", "P", day), ("b", "P", None), ("c", "P", day), ("c", "P", day), ("d", "P", dt.date(2025, 2, 1)), ("e", "Q", None), ("f", "Q", None), ("g", "Q", None)]
    batch = pa.RecordBatch.from_pylist([{alerts.ID: i, alerts.KEY: k, alerts.DATE: d} for i, k, d in rows])
    out = pa.Table.from_batches(alerts._newest_of_batch(iter([batch]))).to_pylist()
    assert sorted(r[alerts.ID] for r in out) == ["c", "d", "f", "g"]
