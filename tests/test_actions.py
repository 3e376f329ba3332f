"""Action ids, validation, append, history and outcomes; the scorer against plain Python."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from renewlens.operators import actions, decide
from renewlens.sources.tables import read_table

def as_of():
    return F.lit("2026-10-03 10:00:00").cast("timestamp_ntz")


def requests(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("C0"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("customer_id"),
        F.concat(F.lit("I"), F.col("id").cast("string")).alias("interaction_id"),
        F.lit("{}").alias("recommended_action"), F.lit("Executed: x").alias("action_taken"), F.lit("EXECUTED").alias("status"),
    )


def test_ids_are_dense_and_wider_than_three_digits(spark, tables):
    rows = actions.log_rows(actions.validate_actions(requests(spark, 1205), tables["customer"], as_of())).collect()
    ids = sorted(int(r.action_id.rsplit("-", 1)[1]) for r in rows)
    assert ids == list(range(1, 1206))
    assert {r.action_id for r in rows} >= {"ACT-20261003-100000-001", "ACT-20261003-100000-999", "ACT-20261003-100000-1205"}


def test_ids_do_not_depend_on_layout(spark, tables):
    def run(df):
        return {(r.interaction_id, r.action_id) for r in actions.log_rows(actions.validate_actions(df, tables["customer"], as_of())).collect()}

    assert run(requests(spark, 300)) == run(requests(spark, 300).repartition(7).orderBy(F.desc("interaction_id")))


def test_unknown_customer_is_rejected(spark, tables, tmp_path):
    asked = requests(spark, 3).unionByName(requests(spark, 1).withColumn("customer_id", F.lit("C999")))
    checked = actions.validate_actions(asked, tables["customer"], as_of())
    results = {r.customer_id: r for r in actions.log_results(checked).collect()}
    assert (results["C999"].status, results["C999"].action_id, results["C999"].message) == ("error", None, "Customer not found")
    assert (results["C001"].status, results["C001"].action_status) == ("ok", "EXECUTED")
    actions.append_actions(checked, str(tmp_path))
    log = read_table(spark, str(tmp_path), "action_log")
    again = actions.validate_actions(asked, tables["customer"], as_of(), existing=log)
    actions.append_actions(again, str(tmp_path))
    ids = [r.action_id for r in read_table(spark, str(tmp_path), "action_log").collect()]
    assert sorted(ids) == [f"ACT-20261003-100000-{n:03d}" for n in range(1, 7)]


def test_written_rows_and_confirmations_share_their_ids(spark, tables):
    checked = actions.validate_actions(requests(spark, 5), tables["customer"])
    rows = {r.action_id for r in actions.log_rows(checked).collect()}
    assert len(rows) == 5 and rows == {r.action_id for r in actions.log_results(checked).collect()}


def test_payload_is_always_whole_json(spark):
    schema = "nba struct<recommended_action struct<code string, title string>, why_this_action string, evidence array<string>>"
    lines = [f'line {i} with "quotes" ' + "x" * 100 for i in range(40)]
    df = spark.createDataFrame([(({"code": "C", "title": "T"}, "why", lines[:2]),), (({"code": "D", "title": "T"}, "why", lines),)], schema)
    texts = [r[0] for r in df.select(actions.log_payload(F.col("nba"), 2000)).collect()]
    small, large = map(json.loads, texts)
    assert small["evidence"] == lines[:2] and "evidence_shortened" not in small
    assert large["recommended_action"]["code"] == "D" and large["evidence_shortened"] and len(texts[1]) <= 2000
    assert large["evidence"] == lines[: len(large["evidence"])] and len(large["evidence"]) > 10


def test_texts(spark):
    df = spark.createDataFrame([("EXECUTED", "T", None), ("PENDING", "T", ""), ("DECLINED", "T", "own words"), ("ESCALATED", "T" * 5000, None)],
                               "status string, title string, override string")
    out = [r[0] for r in df.select(actions.action_text(F.col("status"), F.col("title"), F.col("override"))).collect()]
    assert out[:3] == ["Executed: T", "Pending review: T", "own words"] and out[3] == "Escalated: " + "T" * 5000
    cut = df.select(actions.action_text(F.col("status"), F.col("title"), length=actions.ACTION_LENGTH)).collect()
    assert len(cut[3][0]) == 3500


def test_history_and_outcomes(spark, tables):
    log = spark.range(40).select(
        F.concat(F.lit("A"), F.lpad("id", 3, "0")).alias("action_id"),
        F.when(F.col("id") < 30, "C001").otherwise("C002").alias("customer_id"),
        F.lit(None).cast("string").alias("interaction_id"),
        F.when(F.col("id") % 2 == 0, '{"recommended_action":{"code":"C"}}').otherwise('{"recommended_action":{"code":"D"}}').alias("recommended_action"),
        F.lit("x").alias("action_taken"),
        F.timestamp_seconds(F.col("id") / 2).cast("timestamp_ntz").alias("action_timestamp"),
        F.when(F.col("id") % 4 == 0, "EXECUTED").otherwise("PENDING").alias("status"),
    )
    recent = actions.recent_actions(log, tables["customer"]).orderBy("customer_id", "rank").collect()
    assert [r.action_id for r in recent][:10] == [f"A{i:03d}" for i in range(29, 19, -1)] and len(recent) == 20
    history = actions.newest_first(actions.action_history(log, tables["customer"])).collect()
    assert len(history) == 40 and history[0].customer_name == "Ben East"
    outcomes = {r.code: r for r in actions.action_outcomes(log).collect()}
    assert (outcomes["C"].actions, outcomes["C"].executed, outcomes["C"].executed_rate) == (20, 10, 0.5)
    assert outcomes["D"].pending == 20


def test_scores_against_plain_python(spark):
    """Every combination of the scoring facts, scored independently."""
    names = list(decide.FACTS)
    scoring = sorted({fact for fact, *_ in decide.ADJUSTMENTS})
    rows = []
    for bits in itertools.product([False, True], repeat=len(scoring)):
        facts = dict.fromkeys(names, False) | dict(zip(scoring, bits))
        facts |= {"comparable": facts["major_change"] or facts["small_change"], "high_risk": facts["risk_up"],
                  "high_churn": facts["likely_to_leave"], "valuable": facts["open_claim"]}
        rows.append(tuple(facts[n] for n in names))
    schema = ", ".join(f"{n} boolean" for n in names)
    df = spark.createDataFrame(rows, schema).select(F.struct(*names).alias("fact"))
    supported = {
        "A": lambda f: True, "B": lambda f: f["comparable"] or f["lapsed"], "C": lambda f: f["comparable"],
        "D": lambda f: f["high_risk"], "E": lambda f: f["high_churn"] and f["valuable"],
        "F": lambda f: f["open_claim"] or f["several_claims"] or f["lapsed"] or f["coverage_worry"],
        "G": lambda f: f["incomplete"],
    }
    for row in df.withColumn("candidates", decide.candidates()).collect():
        f = row.fact.asDict()
        expected = []
        for code in decide.MENU:
            points = list(decide.BASE[code])
            for fact, action, criterion, added in decide.ADJUSTMENTS:
                if action == code and f[fact]:
                    points[decide.CRITERIA.index(criterion)] += added
            points = [min(10, max(1, p)) for p in points]
            expected.append((not supported[code](f), -sum(points), code))
        assert [(c.unsupported, c.place, c.code) for c in row.candidates] == sorted(expected)
        assert not row.candidates[0].unsupported


def test_writers_at_once_take_different_numbers(spark, tables):
    """Neither sees what the other is about to append; a later single writer goes on after both."""
    asked = spark.range(30).selectExpr(
        "concat('C', lpad(cast(id % 12 + 1 AS string), 3, '0')) AS customer_id", "cast(id AS string) AS interaction_id",
        "'{}' AS recommended_action", "'call' AS action_taken", "'PENDING' AS status",
    )
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    parts = [actions.validate_actions(asked.filter(F.col("interaction_id").cast("int") % 2 == n), tables["customer"], at, writer=n, writers=2) for n in (0, 1)]
    log = actions.log_rows(parts[0]).unionByName(actions.log_rows(parts[1]))
    later = actions.log_rows(actions.validate_actions(asked.limit(4), tables["customer"], at, existing=log))
    ids = [r["action_id"] for r in log.collect()]
    numbers = sorted(int(i.split("-")[3]) for i in ids)
    assert len(set(ids)) == len(ids) == 30 and numbers == list(range(1, 31))
    assert min(int(r["action_id"].split("-")[3]) for r in later.collect()) == 31
    with pytest.raises(ValueError):
        actions.validate_actions(asked, tables["customer"], at, writer=2, writers=2)
