"""Quality and toxicity: held-out accuracy, calibration, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.llm import quality, toxicity
from renewlens.llm.boosting import fit_additive, fit_trees, isotonic

SF_DIR = "/root/testdata/sf0.01"


def area(score, y):
    above = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    return above + (score[y == 1][:, None] == score[y == 0][None, :]).mean() / 2


@pytest.mark.parametrize("query, label, least", [(quality.op3_quality, "quality", 0.97), (toxicity.op5_toxicity, "toxic", 0.85)])
def test_held_out_area(spark, query, label, least):
    scored = query(spark, SF_DIR).collect()
    assert len(scored) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in scored if r["held_out"] and truth.get(r["doc_id"]) is not None]
    score, y = np.array([r["score"] for r in rows]), np.array([truth[r["doc_id"]] for r in rows])
    assert area(score, y) > least and score.min() >= 0 and score.max() <= 1
    cut = 0.5 if label == "quality" else 0.7
    assert all(r["predicted"] == int(r["score"] >= cut) for r in scored)
    assert np.mean([y[n] for n, r in enumerate(rows) if r["predicted"]]) > 0.9


def test_hold_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    pair = [quality.score_quality(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (labels, turned)]
    assert pair[0] == pair[1]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(3, 1, 0), (4, 1, 1), (6, 0, 1), (8, 0, 0), (4, 1, 1), (9, None, None), (None, 1, 1), (6, 1, 1), (999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        for model in (module.train(odd, labels), module.train(odd, labels.limit(0)), module.train(none, labels)):
            found = score(odd, model).collect()
            assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
            assert len({r["score"] for r in found if r["doc_id"] in (0, 1)}) == 1  # NULL and empty alike
            assert score(none, model).count() == 0


def test_wordless_share_is_of_the_whole_text():
    wordless = lambda text: quality.features(text)[quality.FEATURES.index("wordless")]
    assert wordless(b"word " * 64 + b"| 12 #$ " * 64) == 192 / 256
    assert wordless("| é ж1 12\x1c3 --\x0b\x0cA".encode()) == 3 / 6 and wordless(b" \n") == wordless(b"") == 0
    rng = np.random.default_rng(1)
    for _ in range(50):
        text = bytes(rng.choice(np.frombuffer(b"a1| \n\t\x0b\x1c\x85\xc3Z-", dtype=np.uint8), 300))
        words = text.split()
        assert wordless(text) == sum(not any(97 <= b <= 122 or b >= 128 or 65 <= b <= 90 for b in w) for w in words) / len(words)


def test_disguised_words():
    assert toxicity.spellings("1d1ot!") == ("1d1ot", "idiot", True)
    assert toxicity.spellings("i.d.i.o.t")[1] == "idiot"
    assert toxicity.spellings("stuuuupid")[1] == "stupid"
    assert toxicity.spellings("Idiot,") == ("idiot", "", False)
    reader = toxicity.Reader({"idiot": 3.0})
    plain, hidden, clean = (reader.features(t) for t in (b"you idiot there", b"you 1d1ot there", b"you poet there"))
    assert plain[0] == hidden[0] > clean[0] == 0 and hidden[5] > 0 and plain[7] > 0


def test_boosting_learns_pairs_and_steps():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and area(model.score(x[3000:]), y[3000:]) > 0.9
    z = (x[:, 2] > 0.7).astype(float)
    assert area(fit_trees(x[:3000], z[:3000]).raw(x[3000:]), z[3000:]) > 0.99
    assert fit_additive(x, np.ones(len(x))).score(x).min() > 0.9


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    raw = rng.standard_normal(5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    at, chance = isotonic(raw, y)
    assert (np.diff(chance) >= 0).all() and (np.diff(at) >= 0).all()
    found = np.interp(raw, at, chance)
    for low in (0.1, 0.4, 0.7):
        part = (found > low) & (found < low + 0.2)
        assert abs(found[part].mean() - y[part].mean()) < 0.05
