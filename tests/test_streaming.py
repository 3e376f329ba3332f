"""Feeds over several micro-batches against their batch counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from renewlens.functions.lexicon import SERVICE_ENGLISH
from renewlens.functions.text import dialogue_turns
from renewlens.operators.interactions import score_interactions
from renewlens.operators.risk import assessment_pairs, directions, newest_two
from renewlens.operators.search import build_postings
from renewlens.streaming import feeds


def drip(df, folder, parts):
    """Write ``df`` as files that arrive one by one, split by the predicates ``parts``."""
    for predicate in parts:
        df.filter(predicate).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return feeds.stream_files(spark, folder, schema, "*.parquet", maxFilesPerTrigger="1")


def test_risk_alerts_do_not_depend_on_arrival(spark, tmp_path):
    df = spark.range(600).select(
        F.col("id").alias("risk_assessment_id"),
        # One property holds half of all assessments.
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("long").alias("property_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), ((F.col("id") * 37) % 101).cast("int")).alias("assessment_date"),
        F.element_at(F.expr("array('LOW','MEDIUM','HIGH')"), (F.col("id") % 3 + 1).cast("int")).alias("flood_risk"),
        F.lit("LOW").alias("fire_risk"), F.lit("LOW").alias("earthquake_risk"),
        ((F.col("id") % 97 + 1) / 100).cast("decimal(3,2)").alias("overall_risk_score"),
        F.lit("r").alias("risk_reason"),
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(df, folder, ["risk_assessment_id % 3 = 2", "risk_assessment_id % 3 = 0", "risk_assessment_id % 3 = 1"])
    feeds.risk_alert_feed(source(spark, folder, df.schema), out, str(tmp_path / "ck")).awaitTermination()
    alerts = feeds.latest_risk_alerts(spark, out)
    batch = assessment_pairs(newest_two(df)).filter("assessments = 2").drop("assessments").select("*", *directions())
    assert sorted(alerts.select(batch.columns).collect()) == sorted(batch.collect())


def test_restart_continues_and_late_rows_change_nothing(spark, tmp_path):
    schema = ("risk_assessment_id string, property_id string, assessment_date date, flood_risk string, fire_risk string, "
              "earthquake_risk string, overall_risk_score decimal(3,2), risk_reason string")

    def rows(*items):
        return spark.createDataFrame([(i, "P", dt.date.fromisoformat(d), level, "LOW", "LOW", None, None) for i, d, level in items], schema)

    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        feeds.risk_alert_feed(source(spark, folder, rows().schema), out, ck).awaitTermination()
        return [(r.prev_assessment_id, r.curr_assessment_id, r.flood_direction) for r in feeds.latest_risk_alerts(spark, out).collect()]

    rows(("a", "2025-01-01", "LOW"), ("b", "2025-03-01", "HIGH")).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [("a", "b", "UP")]
    rows(("old", "2024-01-01", "MEDIUM")).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [("a", "b", "UP")]
    rows(("c", "2025-04-01", "LOW")).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [("b", "c", "DOWN")]


def test_interactions_are_scored_once(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, dt.datetime(2026, 1, 1, 0, i % 50), f"my claim {i} and the premium price, thanks") for i in range(50)],
        "interaction_id long, interaction_timestamp timestamp_ntz, text string",
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(df, folder, ["interaction_id < 30", "interaction_id >= 20"])
    feeds.interaction_feed(source(spark, folder, df.schema), out, str(tmp_path / "ck")).awaitTermination()
    turns = dialogue_turns(df, "text")
    got = spark.read.parquet(out).drop("batch")
    expected = score_interactions(turns, SERVICE_ENGLISH)
    assert sorted(got.select(expected.columns).collect()) == sorted(expected.collect())


def test_postings_match_the_batch_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{chr(97 + i % 3)} and more words {'again ' * (i % 4)}") for i in range(30)], "doc_id long, text string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(df, folder, ["doc_id < 10", "doc_id >= 10"])
    feeds.postings_feed(source(spark, folder, df.schema), out, str(tmp_path / "ck")).awaitTermination()
    batch = build_postings(df)
    assert sorted(spark.read.parquet(out).select(batch.columns).collect()) == sorted(batch.collect())


def test_an_agents_words_do_not_raise_churn(spark, tmp_path):
    text = "Agent: Do you want to cancel or switch to a competitor?\nCustomer: No, thanks, all is well."
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), text)], "interaction_id long, interaction_timestamp timestamp_ntz, text string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(df, folder, ["true"])
    feeds.interaction_feed(source(spark, folder, df.schema), out, str(tmp_path / "ck")).awaitTermination()
    batch = score_interactions(dialogue_turns(df, "text")).first()
    row = spark.read.parquet(out).first()
    assert (row.churn_signal, row.retention_risk) == (batch.churn_signal, batch.retention_risk) and row.churn_signal == "none"


def test_redelivery_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two two"), (2, "three")], "doc_id long, text string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(docs.union(docs), folder, ["true", "doc_id = 1"])
    feeds.postings_feed(source(spark, folder, docs.schema), out, str(tmp_path / "ck")).awaitTermination()
    batch = build_postings(docs)
    assert sorted(feeds.latest_postings(spark, out).select(batch.columns).collect()) == sorted(batch.collect())
    schema = ("risk_assessment_id string, property_id string, assessment_date date, flood_risk string, fire_risk string, "
              "earthquake_risk string, overall_risk_score decimal(3,2), risk_reason string")
    one = spark.createDataFrame([("RA002", "P", dt.date(2026, 1, 1), "HIGH", "LOW", "LOW", None, None)], schema)
    folder, out = str(tmp_path / "in2"), str(tmp_path / "out2")
    drip(one.union(one), folder, ["true", "true"])
    feeds.risk_alert_feed(source(spark, folder, one.schema), out, str(tmp_path / "ck2")).awaitTermination()
    assert feeds.latest_risk_alerts(spark, out).count() == 0


def test_hours_are_added_up_with_late_rows(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [(start + dt.timedelta(minutes=7 * i), "PENDING" if i % 3 else "EXECUTED") for i in range(100)],
        "action_timestamp timestamp_ntz, status string",
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(df, folder, ["action_timestamp >= '2026-01-01 06:00:00'", "action_timestamp < '2026-01-01 06:00:00'"])
    feeds.hourly_counts_feed(source(spark, folder, df.schema), out, str(tmp_path / "ck")).awaitTermination()
    batch = df.groupBy(F.date_trunc("hour", "action_timestamp").alias("hour"), "status").agg(F.count("*").alias("actions"))
    assert sorted(map(str, feeds.hourly_counts(spark, out).collect())) == sorted(map(str, batch.collect()))
