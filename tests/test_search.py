"""Searches against brute force on small data."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from renewlens.operators import search
from renewlens.plans import catalogue
from renewlens.sources import sales

SF_DIR = "/root/testdata/sf0.001"

DOCS = [
    (1, "the flood raised the premium of the house"),
    (2, "renewal premium and flood cover"),
    (3, "invoice and autopay charge"),
    (4, "flood flood flood"),
    (5, ""),
    (6, "The PREMIUM went up. The premium went up again!"),
]
QUERIES = [(10, "flood premium"), (11, "why is the premium up"), (12, "zebra")]


def bm25(k=2, k1=1.2, b=0.75):
    toks = {d: re.findall("[a-z]+", t.lower()) for d, t in DOCS}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ws in toks.values() for w in set(ws))
    out = []
    for q, text in QUERIES:
        scores = []
        for d, ws in toks.items():
            tf, total, hit = Counter(ws), 0.0, False
            for w, qtf in Counter(re.findall("[a-z]+", text.lower())).items():
                if tf[w]:
                    hit = True
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    total += qtf * idf * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean))
            if hit:
                scores.append((-math.floor(total * 1e4 + 0.5) / 1e4, d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def found(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.text_match) for r in df.collect())


def test_text_search(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert found(search.text_search(docs, queries, k=2)) == sorted(bm25())


def test_text_search_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "is_small", lambda df, rows=0: False)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert found(search.text_search(docs, queries, k=2)) == sorted(bm25())


def test_stored_postings_give_the_same_ranking(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    ranked = search.rank_postings(search.build_postings(docs, anchored=True), search.query_words(queries), k=2)
    assert found(ranked) == sorted(bm25())


def test_size_check(spark):
    assert search.is_small(spark.range(10), 10) and not search.is_small(spark.range(11), 10)


def vectors(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 8)).astype("float32")


def cosine_top(corpus, queries, k):
    c = corpus.astype("float64") / np.linalg.norm(corpus.astype("float64"), axis=1, keepdims=True)
    q = queries.astype("float64") / np.linalg.norm(queries.astype("float64"), axis=1, keepdims=True)
    scores = np.floor(c @ q.T * 1e6 + 0.5) / 1e6
    return sorted(
        (j, r + 1, int(i))
        for j in range(len(queries))
        for r, i in enumerate(sorted(range(len(corpus)), key=lambda i: (-scores[i, j], i))[:k])
    )


def test_vector_search_both_ways(spark, monkeypatch):
    corpus, queries = vectors(300, 1), vectors(7, 2)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<float>").repartition(5)
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    expected = cosine_top(corpus, queries, 4)

    def run(**kw):
        return sorted((r.query_id, r.rank, r.vec_id) for r in search.vector_search(left, right, 4, **kw).collect())

    assert run() == expected
    monkeypatch.setattr(search, "BROADCAST_VECTORS", 2)
    assert run(slices=3) == expected


def test_vector_of_zeros_and_no_queries(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    right = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.cosine_similarity) for r in search.vector_search(left, right, 5).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert search.vector_search(left, right.filter("query_id < 0"), 5).collect() == []


def test_vectors_with_text_ids_and_gaps(spark):
    corpus, queries = vectors(60, 3), vectors(4, 4)
    left = spark.createDataFrame(
        [(f"v{i:03d}", v.tolist(), i % 2) for i, v in enumerate(corpus)] + [("none", None, 0)], "vec_id string, embedding array<float>, kind int"
    )
    right = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)] + [("none", None)], "query_id string, embedding array<float>")
    rows = search.vector_search(left, right, 3).collect()
    assert sorted((int(r.query_id[1:]), r["rank"], int(r.vec_id[1:])) for r in rows) == cosine_top(corpus, queries, 3)
    odd = search.vector_search(left, right, 3, only=F.col("kind") == 1).collect()
    assert len(odd) == 12 and all(int(r.vec_id[1:]) % 2 for r in odd)


def test_sub_blocks_do_not_change_the_best(spark, monkeypatch):
    corpus, queries = vectors(200, 5), vectors(9, 6)
    corpus[10:30] = corpus[5]  # ties go to the smaller id across blocks
    monkeypatch.setattr(search, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    unit = lambda m: m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    found = search._batch_best(np.arange(200), unit(corpus), np.arange(9), unit(queries), 4)
    ranked = sorted((q, r + 1, int(v)) for q in range(9) for r, v in enumerate(found[found.query_id == q].vec_id))
    assert ranked == cosine_top(corpus, queries, 4)


def test_words_of_every_script(spark):
    docs = spark.createDataFrame([(1, "Herr Müller zahlt 2024"), (2, "жизнь прекрасна"), (3, "mller 20 24")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "MÜLLER"), (2, "Жизнь"), (3, "2024")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in search.text_search(docs, queries).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_phrases_from_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Rate is 100% up"), (2, "a_b and 1000")], "doc_id long, text string")
    phrases = spark.createDataFrame([("100%",), ("A_B",), (None,), ("",), ("100%",)], "phrase string")
    monkeypatch.setattr(search, "PHRASE_CONSTANTS", 1)
    assert sorted(tuple(r) for r in search.substring_search(docs, phrases).collect()) == [(1, "100%"), (2, "A_B")]
    assert search.substring_search(docs, phrases.limit(0)).count() == 0


def test_substring_search(spark):
    docs = spark.createDataFrame([(1, "Rate is 100% up"), (2, "a_b and 1000"), (3, "aXb"), (4, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.phrase) for r in search.substring_search(docs, ["100%", "A_B", "RATE"]).collect()}
    assert rows == {(1, "100%"), (2, "A_B"), (1, "RATE")}


def test_attributes(spark):
    docs = spark.createDataFrame([(d, t, f"kind{d % 2}") for d, t in DOCS], "doc_id long, text string, kind string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = search.with_attributes(search.text_search(docs, queries, 1), docs, "kind").collect()
    assert all(r.kind == f"kind{r.doc_id % 2}" for r in rows) and rows


def test_interactions_are_searched_by_attribute(spark, tables):
    queries = spark.createDataFrame([(1, "renewal premium"), (2, "claim adjuster")], "query_id long, text string")
    rows = search.search_interactions(tables["interaction"], queries, 2).collect()
    assert {r.interaction_id for r in rows if r.query_id == 2 and r["rank"] == 1} == {"INT002"}
    mine = search.search_interactions(tables["interaction"], queries, 5, only=F.col("customer_id") == "C006").collect()
    assert {r.interaction_id for r in mine} == {"INT006"} and mine[0].interaction_type == "CALL"


def test_registered_search_reads_every_call(spark):
    calls = sales.interactions(spark, SF_DIR).filter("interaction_type = 'CALL' AND raw_transcript IS NOT NULL").collect()
    toks = {r.interaction_id: re.findall("[a-z0-9]+", r.raw_transcript.lower()) for r in calls}
    n, mean, df = len(toks), sum(map(len, toks.values())) / len(toks), Counter(w for ws in toks.values() for w in set(ws))
    expected = []
    for (key,) in sales.scan(spark, SF_DIR, "nation").select("n_nationkey").collect():
        scores = []
        for doc, ws in toks.items():
            tf = Counter(ws)
            gains = [
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                for w in ("k", str(key)) if tf[w]
            ]
            if gains:
                scores.append((-math.floor(sum(gains) * 1e4 + 0.5) / 1e4, doc))
        expected += [(key, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(scores)[:5])]
    rows = catalogue.search_interactions(spark, SF_DIR).collect()
    assert any(doc % 2 for _, _, doc, _ in expected)
    assert sorted((r.query_id, r["rank"], r.interaction_id, r.text_match) for r in rows) == sorted(expected)


def test_registered_vector_search_reads_every_vector(spark):
    rows = sales.scan(spark, SF_DIR, "embeddings").collect()
    unit = lambda v: np.array(v, dtype="float64") / np.linalg.norm(np.array(v, dtype="float64"))
    expected = []
    for label in {r.label for r in rows}:
        asked = unit(np.mean([np.array(r.embedding, dtype="float64") for r in rows if r.label == label], axis=0))
        scores = [(-math.floor(unit(r.embedding) @ asked * 1e6 + 0.5) / 1e6, f"INT{r.vec_id}") for r in rows if r.label < 5]
        expected += [(f"Q{label}", i + 1, vec) for i, (_, vec) in enumerate(sorted(scores)[:5])]
    found = catalogue.vector_search_interactions(spark, SF_DIR).collect()
    assert any(int(vec[3:]) % 7 == 0 for _, _, vec in expected)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == sorted(expected)
