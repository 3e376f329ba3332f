"""Substring search with phrase tables against looking for every phrase in every text."""

from __future__ import annotations

import random

import pytest

from renewlens.operators import phrases, search

TEXTS = (
    None, "", "a", "The Flood raised the premium", "flood and FLOOD again, flooded", "ünï côde ÜNÏ çafé", "100% of A_B\\n", "the the the the",
    "x" * 3_000 + "needle in a long text" + "y" * 5_000, "needle in a long tex", "tail end", "\x00odd\x00bytes", "日本語のテキスト",
)
ASKED = (
    None, "", "a", "A", "th", "the", "THE ", "flood", "Flood raised the prem", "needle in a long text", "ünï", "çafé", "é", "100%", "A_B\\n", "d\x00b", "本語",
    "zebra", "tail end", "ail", "x" * 3_000 + "needle", "x" * 3_000 + "Needle in a long text" + "y" * 5_000, "x" * 3_001 + "needle", "y" * 4_000, "flood", "日本語のテキスト",
)


def slow(texts, asked):
    return sorted({(p, n) for p in asked if p for n, t in enumerate(texts) if t is not None and p.lower() in t.lower()})


def found(spark, texts, asked, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS phrase", "2 AS body", "3 AS anchor").repartition(3)
    table = spark.createDataFrame([(p, 1) for p in asked], "phrase string, doc_id int")
    return sorted(tuple(r) for r in phrases.phrase_search(docs, table, **how).collect())


@pytest.mark.parametrize("asked", [ASKED, [p for p in ASKED if p is None or len(p) < 100]])
def test_equals_brute_force(spark, asked):
    assert found(spark, TEXTS, asked) == slow(TEXTS, asked)


def test_many_phrases_that_share_their_windows(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choices("ab c", k=n))
    texts = [text(draw.randint(0, 300)) for _ in range(60)]
    asked = [text(draw.randint(1, 14)) for _ in range(400)] + [t[5:20] for t in texts] + [t[:-1] for t in texts]
    assert found(spark, texts, asked, sample_rows=20) == slow(texts, asked)


def test_nothing_asked_and_nothing_there(spark):
    assert found(spark, TEXTS, [None, ""]) == [] and found(spark, [None, ""], ["a"]) == []


def test_rows_with_equal_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "one flood"), (1, "two floods"), (None, "flood"), (None, "flood")], "doc_id long, text string")
    table = spark.createDataFrame([("flood",), ("two",)], "phrase string")
    rows = phrases.phrase_search(docs, table).collect()
    assert sorted(map(str, rows)) == sorted(["Row(phrase='flood', doc_id=1)", "Row(phrase='two', doc_id=1)", "Row(phrase='flood', doc_id=None)"])


def test_texts_are_scanned_once_and_no_phrase_goes_to_the_driver(spark, tmp_path, monkeypatch):
    """100,000 phrases: one pass over the texts, whatever their number."""
    texts = spark.range(300).selectExpr("id AS doc_id", "concat('number ', id, ' of the document ', id * 7919 % 100000) AS text")
    texts.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    table = spark.range(100_000).selectExpr("concat('document ', id) AS phrase")
    df = search.substring_search(docs, table)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/docs") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    expected = {(f"document {str(i * 7919 % 100000)[:k]}", i) for i in range(300) for k in range(1, 6)}
    assert {tuple(r) for r in df.collect()} == {(p, i) for p, i in expected if not p.endswith(" 0") or p == "document 0"} | {
        (p, i) for p, i in expected if p == "document 0"
    }
