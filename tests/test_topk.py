"""Bounded text search, over one table and over streamed segments, against scoring everything."""

from __future__ import annotations

import random

import pytest

from renewlens.operators import search, topk
from renewlens.plans import catalogue
from renewlens.session import written
from renewlens.streaming import feeds, segments

SF_DIR = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made_up(spark, n=300, seed=1):
    """Words with Zipf-like frequencies; queries of one to twelve words, some repeated, some unknown."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda m: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=m))
    docs = [(i, pick(draw.randint(0, 40)) if i % 17 else None) for i in range(n)] + [(n, ""), (n + 1, "w1 w1 w1")]
    queries = [(i, pick(draw.randint(1, 12))) for i in range(25)] + [(25, "unknown"), (26, ""), (27, None), (28, "w0 w0 w0 w59")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("k, seed, broadcast_rows", [(1, 1, 1000), (5, 2, 1000), (5, 3, 0), (400, 4, 1000)])
def test_rows_are_those_of_scoring_everything(spark, k, seed, broadcast_rows):
    docs, queries = made_up(spark, seed=seed)
    assert rows(topk.bounded_text_search(docs, queries, k, broadcast_rows)) == rows(search.text_search(docs, queries, k))


def test_equal_scores_are_not_lost(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(99, "other")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "words here"), (2, "same other")], "query_id long, text string")
    assert rows(topk.bounded_text_search(docs, queries, 3)) == rows(search.text_search(docs, queries, 3))


def test_far_fewer_documents_are_scored(spark):
    docs, queries = catalogue._searched(spark, SF_DIR)
    wanted = written(search.query_words(queries), "words")
    postings = search.asked_postings(docs, wanted)
    bounded = topk.prepare(postings, wanted)
    least = topk.thresholds(bounded)
    opened = topk.candidates(bounded, least).count()
    every = bounded.gains.join(bounded.weights, "word").select("query_id", "doc_id").distinct().count()
    asked = wanted.select("query_id").distinct().count()
    seeds = asked * topk.SEED_WORDS * bounded.k
    assert every > 0.5 * docs.count() * asked  # nearly every document shares a word with every query
    assert opened < 0.1 * every and seeds < 0.2 * every
    assert rows(topk.bounded_rank(postings, wanted)) == rows(search.rank_postings(postings, wanted))


def test_nothing_to_search(spark):
    docs, queries = made_up(spark)
    assert topk.bounded_text_search(docs.limit(0), queries).count() == 0
    assert topk.bounded_text_search(docs, queries.limit(0)).count() == 0


class Index:
    """A segmented index in a folder, fed by lists of rows."""

    def __init__(self, spark, path, versions=True):
        self.spark, self.folder, self.out, self.offsets = spark, str(path / "in"), str(path / "out"), str(path / "offsets")
        self.version = "version" if versions else None

    def feed(self, *given):
        frame = self.spark.createDataFrame(list(given), "doc_id long, text string, version int")
        frame.coalesce(1).write.mode("append").parquet(self.folder)
        arriving = feeds.stream_files(self.spark, self.folder, frame.schema, "*.parquet", maxFilesPerTrigger="1")
        segments.segment_feed(arriving, self.out, self.offsets, self.version).awaitTermination()

    def find(self, text, k=5):
        queries = self.spark.createDataFrame([(1, text)], "query_id long, text string")
        return [r["doc_id"] for r in segments.search_segments(self.spark, self.out, queries, k).orderBy("rank").collect()]


def test_last_version_wins_in_any_order(spark, tmp_path):
    index = Index(spark, tmp_path)
    index.feed((1, "flood damage", 5), (2, "fire damage", 1), (None, "flood", 1))
    index.feed((1, "stale flood flood", 4), (2, "flood cover", 2), (2, "fire fire", 1), (3, "storm", None))
    assert sorted(index.find("flood")) == [1, 2] and index.find("fire") == [] and index.find("stale") == []
    assert segments.merge_segments(spark, index.out) == 1 == segments.merge_segments(spark, index.out)
    assert sorted(index.find("flood")) == [1, 2] and index.find("fire") == []
    index.feed((2, None, 3), (1, "calm", 3), (3, "storm flood", None))
    assert sorted(index.find("flood")) == [1, 3]
    assert segments.merge_segments(spark, index.out) == 2
    index.feed((2, "flood once more", 2))
    assert sorted(index.find("flood")) == [1, 3]
    merged = spark.read.parquet(f"{index.out}/merged/upto=2/postings")
    assert {r["doc_id"] for r in merged.select("doc_id").distinct().collect()} == {1, 3}


def test_without_versions_arrival_decides(spark, tmp_path):
    index = Index(spark, tmp_path, versions=False)
    index.feed((1, "old", 9))
    index.feed((1, "new", 1))
    assert index.find("old") == [] and index.find("new") == [1]


def test_statistics_are_those_of_live_documents(spark, tmp_path):
    index = Index(spark, tmp_path)
    docs, queries = made_up(spark, 60)
    given = [(r["doc_id"], r["text"], 1) for r in docs.collect()]
    index.feed(*[(d, "w1 w2 w3 " * 5, 0) for d, _, _ in given[::3]])
    index.feed(*given[:30])
    segments.merge_segments(spark, index.out)
    index.feed(*given[25:])
    assert rows(segments.search_segments(spark, index.out, queries)) == rows(search.text_search(docs, queries))


def test_an_unfinished_merge_is_not_read(spark, tmp_path):
    index = Index(spark, tmp_path)
    index.feed((1, "flood", 1))
    segments.live_postings(spark, index.out).limit(0).write.parquet(f"{index.out}/merged/upto=0/postings")
    assert index.find("flood") == [1]
