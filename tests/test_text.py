"""Dialogue, words, lexicon scores, model output and the model seam."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from renewlens.functions import model_json
from renewlens.functions.display import title_case
from renewlens.functions.lexicon import Lexicon
from renewlens.functions.text import dialogue_turns, sentences, words
from renewlens.operators import interactions as ix
from renewlens.sources.tables import from_documents, search_source, to_documents


def test_dialogue_turns(tables):
    turns = dialogue_turns(tables["interaction"])
    rows = {(r.interaction_id, r.turn_no): r for r in turns.collect()}
    first = [rows["INT001", i] for i in range(3)]
    assert [r.speaker for r in first] == ["Agent", "Customer", "Agent"]
    # A line without a label belongs to the turn before it.
    assert "I may look at other options." in first[1].text
    mail = rows["INT004", 0]
    assert (mail.speaker, mail.subject) == ("Customer", "Last invoice")
    assert mail.text.strip().startswith("The autopay charge")


def test_words_and_sentences(spark):
    df = spark.createDataFrame([("One two. Three!? four\nfive  ...",)], "t string")
    row = df.select(words(F.col("t")).alias("w"), sentences(F.col("t")).alias("s")).first()
    assert row.w == ["one", "two", "three", "four", "five"]
    mixed = spark.createDataFrame([("Müller's ÄRGER, 2024: жизнь — naïve",)], "t string").select(words(F.col("t"))).first()[0]
    assert mixed == ["müller", "s", "ärger", "2024", "жизнь", "naïve"]
    assert row.s == ["One two.", "Three!?", "four", "five  ..."]


def test_intents_of_the_portfolio(tables):
    scores = ix.score_interactions(dialogue_turns(tables["interaction"]))
    rows = {r.interaction_id: r for r in scores.collect()}
    assert {k: rows[k].intent for k in ("INT001", "INT002", "INT004")} == {
        "INT001": "renewal_inquiry", "INT002": "claim_status", "INT004": "billing_question"
    }
    assert rows["INT003"].churn_signal == "high" and rows["INT003"].retention_risk == "HIGH"
    assert rows["INT001"].pricing_concern and rows["INT001"].coverage_concern
    assert all(-1 <= r.sentiment <= 1 for r in rows.values())


def test_interaction_documents(spark, tables):
    extra = tables["interaction"].unionByName(
        spark.createDataFrame(
            [("INT900", "C001", "CALL", None, "  ", None), ("INT901", "C001", "CALL", None, None, None)],
            tables["interaction"].schema,
        )
    )
    asked = extra.select("interaction_id").unionByName(spark.createDataFrame([("INT999",)], "interaction_id string"))
    docs = ix.analyze_interactions(asked, extra.drop("raw_transcript"), dialogue_turns(extra), tables["customer"])
    rows = {r.interaction_id: r for r in docs.collect()}
    assert rows["INT999"].status == "not_found"
    assert rows["INT900"].status == rows["INT901"].status == "empty_transcript"
    assert rows["INT900"].doc.message == "Transcript is empty — cannot analyze"
    doc = rows["INT001"].doc
    assert rows["INT001"].status == "ok" and doc.intent.raw.label == doc.intent.label
    assert doc.summary and 1 <= len(doc.key_phrases) <= 5


def test_summary_takes_frequent_sentences_in_order(spark):
    text = "Alpha beta gamma. Rare words here. Alpha beta. Nothing similar today. Alpha gamma beta alpha."
    turns = spark.createDataFrame([("i", 0, "Customer", text)], "interaction_id string, turn_no long, speaker string, text string")
    for one_row_each in (False, True):
        got = ix.summarize(turns, one_row_each=one_row_each).first().summary
        assert got == "Alpha beta gamma. Alpha beta. Alpha gamma beta alpha."


def test_large_lexicon_is_not_broadcast_by_hint(spark):
    big = Lexicon({f"w{i}": 1.0 for i in range(50_001)}, {"complaint": ("bad",)}, {"churn": ("leave",)})
    turns = spark.createDataFrame([("i", 0, "Customer", "good? Poor! bad")], "interaction_id string, turn_no long, speaker string, text string")
    row = ix.lexicon_hits(turns, Lexicon({"good": 1.0, "poor": -0.5}, {"complaint": ("bad",)}, {"churn": ("leave",)})).first()
    assert (row.tone_sum, row.tone_hits, row.intent_complaint, row.signal_churn) == (0.5, 2, 1, 0)
    plan = big.frame(spark)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan


def test_signals_of_model_text(spark):
    cases = {
        "full": '{"urgency":"high","churn_signal":"low","pricing_concern":"true","key_phrases":["a","b"]}',
        "partial": '{"other": 1}',
        "fenced": '```json {"urgency":"high"} ```',
        "broken": '{"urgency":',
        "absent": None,
        "number": "5",
    }
    df = spark.createDataFrame(list(cases.items()), "id string, raw string")
    rows = {r.id: r.signals for r in model_json.with_signals(df, "raw").collect()}
    assert (rows["full"].urgency, rows["full"].pricing_concern, rows["full"].key_phrases) == ("high", True, ["a", "b"])
    for name in ("partial", "absent", "number"):
        assert rows[name].urgency is None and not rows[name].parse_error
    for name in ("fenced", "broken"):
        got = rows[name]
        assert got.parse_error and got.raw_output == cases[name] and got.key_phrases == []
        assert (got.urgency, got.churn_signal, got.recommended_tone) == ("medium", "unknown", "empathetic")


def test_recommendation_from_model_text(spark):
    good = '{"recommended_action":{"code":"D","title":"t"},"evidence":["e"]}'
    rows = [("first", good, None), ("retry", "oops", good), ("none", "oops", "again"), ("lost", "oops", None), ("absent", None, good)]
    df = spark.createDataFrame(rows, "id string, primary string, retry string")
    out = {r.id: r.nba for r in model_json.with_recommendation(df, "primary", "retry").collect()}
    assert out["first"].recommended_action.code == out["retry"].recommended_action.code == "D"
    assert out["first"].recommended_action.priority == "MEDIUM" and out["first"].risk_flags == []
    for name in ("none", "lost"):
        assert out[name].recommended_action.code == "B" and out[name].parse_error
    # Absent text is no failure: nothing is recommended and nothing is retried.
    assert out["absent"].recommended_action.code == "?" and not out["absent"].parse_error


def test_model_seam_scores_only_new_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "yy")], "interaction_id string, text string")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"interaction_id": batch["interaction_id"], "score": batch["text"].str.len().astype(float)})

    first = ix.apply_model(df, model, "interaction_id string, score double", "v1")
    assert {(r.interaction_id, r.score, r.model_version) for r in first.collect()} == {("a", 1.0, "v1"), ("b", 2.0, "v1")}
    more = df.unionByName(spark.createDataFrame([("c", "zzz")], df.schema))
    again = ix.apply_model(more, model, "interaction_id string, score double", "v1", done=first)
    assert [r.interaction_id for r in again.collect()] == ["c"]


def test_documents_round_trip(spark, tables):
    doc = tables["interaction"].select("interaction_id", F.struct("customer_id", "agent_note").alias("doc"))
    schema = doc.schema["doc"].dataType
    text = to_documents(doc, "doc", "interaction_id")
    assert "agent_note" not in text.filter("interaction_id = 'INT001'").first().doc
    back = from_documents(text, "doc", schema)
    assert sorted(back.collect()) == sorted(doc.collect())
    assert "interaction_id" in search_source(tables["interaction"]).columns


def test_title_case(spark):
    row = spark.range(1).select(title_case(F.lit("retention-focused")), title_case(F.lit("SINGLE_FAMILY"))).first()
    assert tuple(row) == ("Retention Focused", "Single Family")
