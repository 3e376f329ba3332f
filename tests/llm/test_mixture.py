from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from renewlens.llm import mixture

SF_DIR = "/root/testdata/sf0.01"


def test_marginals_meet_targets(spark):
    rows = mixture.prepared(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    cell = mixture.cells(rows)
    wanted = {m: mixture.tempered_targets(cell, m) for m in mixture.MARGINS}
    weights = mixture.rake(cell, wanted)
    for m, target in wanted.items():
        off = weights.groupBy(m).agg(F.sum("weight").alias("w")).join(target, m).select(F.abs(F.col("w") - F.col("target")).alias("d"))
        assert off.agg(F.max("d")).first()[0] < 1e-4, m


def test_given_targets_and_sample(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lang = spark.createDataFrame([("en", 0.25), ("de", 0.25), ("fr", 0.5), ("xx", 7.0)], "lang string, target double")
    rows = mixture.prepared(docs)
    targets = {m: mixture.tempered_targets(mixture.cells(rows), m, 1.0) for m in ("source", "topic")} | {"lang": lang}
    found = mixture.mix(docs, targets, budget=0.4)
    total = rows.agg(F.sum("n_tokens")).first()[0]
    expected = {r["lang"]: r["t"] / total for r in found.groupBy("lang").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    assert expected == pytest.approx({"en": 0.1, "de": 0.1, "fr": 0.2, "es": 0.0}, abs=0.002)
    drawn = {r["lang"]: r["t"] / total for r in found.groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert drawn == pytest.approx(expected, abs=0.05)
    taken = mixture.sample(docs, targets, budget=0.4)
    assert {(r["doc_id"], r["mix_copies"]) for r in taken.collect()} == {(r["doc_id"], r["copies"]) for r in found.filter("copies > 0").collect()}
    assert taken.columns == [*docs.columns, "mix_rate", "mix_copies"]


def test_odd_rows(odd, none):
    found = mixture.mix(odd, budget=1.0)
    assert found.count() == odd.count()
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[0]["rate"] == by[1]["rate"] == by[2]["rate"] == 0.0 and by[0]["topic"] == "empty"
    assert {r["source"] for r in found.collect()} == {"src0", mixture.NONE}
    assert mixture.mix(none).count() == 0 and mixture.sample(none).count() == 0
    assert mixture.sample(odd).columns == [*odd.columns, "mix_rate", "mix_copies"]


@pytest.mark.parametrize("text, kind", [(None, "empty"), ("", "empty"), ("a | b | c", "table"), ("LOUD!! NOISE!!", "shouting"), ("a%%% b###", "symbols"), ("Some prose here.", "prose")])
def test_topics(make, text, kind):
    assert make(text).select(mixture.topic(F.col("text"))).first()[0] == kind


def cells_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, lang string, topic string, tokens double")


NEARLY = (("a", "x", "t", 0.6), ("a", "y", "t", 1e-4), ("b", "x", "t", 1e-4), ("b", "y", "t", 0.4))


@pytest.mark.parametrize("at_once", [mixture.CELLS_AT_ONCE, 0])
def test_nearly_exclusive_cells_are_swept_until_the_targets_are_met(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixture, "CELLS_AT_ONCE", at_once)
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.8), ("y", 0.2)], "lang string, target double"),
    }
    found = mixture.rake(cells_of(spark, *NEARLY), targets, tolerance=1e-5).collect()
    share = lambda c, v: sum(r["weight"] for r in found if r[c] == v)
    assert share("source", "a") == pytest.approx(0.5, abs=1e-4) and share("lang", "x") == pytest.approx(0.8, abs=1e-4)


def test_targets_that_contradict_each_other_are_told(spark):
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.8), ("y", 0.2)], "lang string, target double"),
    }
    with pytest.warns(UserWarning, match="off by 0.3"):
        found = mixture.rake(cells_of(spark, NEARLY[0], NEARLY[3]), targets, most=8).collect()
    assert {r["lang"]: round(r["weight"], 9) for r in found} == {"x": 0.8, "y": 0.2}


def test_repeated_target_categories_add_up(spark, make):
    docs = make("one two", "three four", "five six")
    lang = spark.createDataFrame([("en", 0.25), ("en", 0.75)], "lang string, target double")
    assert sorted(mixture.mix(docs, {"lang": lang}, budget=1.0).collect()) == sorted(mixture.mix(docs, budget=1.0).collect())


def test_helper_names_are_free(make):
    docs = make("one two", "three four").selectExpr("*", "1 AS mix_source", "2 AS MIX_LANG", "3 AS mix_topic", "4 AS _mix_topic", "5 AS cell_rate")
    assert mixture.sample(docs, budget=1.0).columns == [*docs.columns, "mix_rate", "mix_copies"]


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \n\t ", 0), ("one", 1), ("  one  two\n", 2), ("a b c", 2)])
def test_tokens(make, text, n):
    assert make(text).select(mixture.tokens(F.col("text"))).first()[0] == n
