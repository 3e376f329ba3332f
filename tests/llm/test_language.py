from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.llm import language

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_folding():
    assert "".join(map(chr, language.folded("Ab, c!É".encode()))) == "   ab c é"
    assert len(language.folded(b"12 !?")) == 0 and len(language.folded(b"")) == 0


def test_probabilities_sum_to_one():
    text = "the cat sat on the mat and the dog sat on the cat"
    codes = language.folded(text.encode())
    grams = np.stack([codes[k : len(codes) - 3 + k] for k in range(4)], axis=1)
    kinds, count = language._unique(grams)
    model = language.fit(["en", "xx"], np.repeat([0, 1], [len(kinds), 1]), np.concatenate((kinds, [[32, 32, 32, 120]])), np.append(count, 1))
    alphabet = np.unique(np.append(codes, 120))
    for head in ("   ", " th", "zzz", "cat", "q a"):
        before = np.array([ord(c) for c in head], dtype=np.uint32)
        logs = [model.logs(np.append(before, c).astype(np.uint32), np.array([3]), 4)[0] for c in [*alphabet, 9999]]
        assert np.exp(np.array(logs)).sum(axis=0) == pytest.approx(1.0, abs=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.op7_language(spark, SF_DIR).join(docs, "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1
    assert found.filter("rejected").count() == 0


def test_odd_rows(spark, model, odd, none):
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == found[2]["lang_pred"] == found[7]["lang_pred"] == "und"
    assert found[0]["score"] == 0.0 and found[0]["rejected"]
    assert found[3]["lang_pred"] in model.languages and not found[3]["rejected"]
    kept = language.identify(odd, model)
    assert set(kept.columns) == {*odd.columns, "lang_pred", "rejected"} and kept.count() == odd.count()
    assert language.identify(none, model).count() == 0


def test_strange_text_is_rejected(spark, model, make):
    found = language.identify(make("жизнь прекрасна и удивительна каждый день " * 20), model).first()
    assert found["rejected"]


def test_without_labels(spark, odd, none):
    assert language.train(none) is None
    assert language.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    assert language.train(odd) is not None  # one language
