"""Plans and results when one key holds a large share of all rows."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from renewlens.operators import interactions as ix
from renewlens.operators.customer360 import claim_summary, latest_interaction
from renewlens.operators.risk import newest_two
from renewlens import session
from renewlens.plans import catalogue
from renewlens.plans.catalogue import PROSE, QUERIES
from renewlens.session import shared_folder
from renewlens.sources import sales

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_plan_multiplies_rows(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@needs_data
def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["claim_summary"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in text
    assert "l_tax" not in text and "l_quantity" not in text


def hot(spark, n=30_000):
    """A third of all rows belongs to customer 0."""
    return spark.range(n).select(
        F.col("id").alias("interaction_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("long").alias("customer_id"),
        F.timestamp_seconds((F.col("id") * 7919) % 100_003).cast("timestamp_ntz").alias("interaction_timestamp"),
        F.lit("t").alias("raw_transcript"),
    )


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = latest_interaction(hot(spark))
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    rows = {r.customer_id: r.interaction_id for r in df.collect()}
    best = hot(spark).toPandas().sort_values(["interaction_timestamp", "interaction_id"]).groupby("customer_id").tail(1)
    assert rows == dict(zip(best.customer_id, best.interaction_id))


def test_newest_two_of_a_hot_property(spark):
    df = hot(spark).select(
        F.col("interaction_id").alias("risk_assessment_id"), F.col("customer_id").alias("property_id"),
        F.to_date("interaction_timestamp").alias("assessment_date"),
    )
    rows = newest_two(df).filter("property_id = 0").orderBy("rn").collect()
    expected = df.filter("property_id = 0").orderBy(F.desc("assessment_date"), F.desc("risk_assessment_id")).limit(2)
    assert [r.risk_assessment_id for r in rows] == [r.risk_assessment_id for r in expected.collect()]


def test_hot_customer_is_combined_before_the_shuffle(spark):
    claims = hot(spark).select(
        "customer_id", F.lit("OPEN").alias("claim_status"), F.lit(1).cast("decimal(12,2)").alias("claim_amount"),
        F.to_date("interaction_timestamp").alias("claim_date"),
    )
    df = claim_summary(claims)
    assert "partial_sum" in plan(df)
    assert {r.customer_id: r.total_claims for r in df.collect()}[0] == hot(spark).filter("customer_id = 0").count()


def test_long_conversation_is_never_gathered(spark):
    turns = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("long").alias("interaction_id"),
        F.col("id").alias("turn_no"), F.lit("Customer").alias("speaker"),
        F.concat(F.lit("the premium from "), F.col("id").cast("string"), F.lit(" is high. with the thanks")).alias("text"),
    )
    scored = ix.score_interactions(turns, PROSE)
    assert "collect_list" not in plan(scored) and "partial_" in plan(scored)
    assert scored.filter("interaction_id = 0").first().churn_signal == "high"
    picked = ix.summary_sentences(turns).groupBy("interaction_id").count().collect()
    assert {r["count"] for r in picked} == {3}
    assert ix.key_phrases(turns, PROSE).filter("interaction_id = 0").count() == 5


class Session:
    """Just enough of a session to ask for a folder."""

    def __init__(self, folder, master):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master = master


def test_shared_folder_follows_the_setting():
    cluster = Session("hdfs://shared/work/", "yarn")
    first, second = shared_folder(cluster, "x"), shared_folder(cluster, "x")
    assert first != second and first.startswith("hdfs://shared/work/x-")
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"), "x")
    assert "x-" in shared_folder(Session(None, "local[2]"), "x")


@needs_data
def test_tables_are_defined_on_demand(spark):
    tables = sales.sales_tables(spark, SF_DIR)
    assert list(tables) == ["customer", "property", "policy_version", "risk_history", "claim", "interaction", "action_log"]
    assert tables["customer"] is tables["customer"]


@needs_data
def test_inputs_are_read_once(spark, monkeypatch):
    """Scans of the large inputs, in the plans of the products and in those of the tables they write."""
    reads = []

    def counted(df, purpose):
        reads.append(plan(df))
        return session.written(df, purpose)

    monkeypatch.setattr(sales, "written", counted)
    monkeypatch.setattr(ix, "written", counted)
    monkeypatch.setattr(catalogue, "written", counted)

    def scans(name, table):
        reads.clear()
        reads.append(plan(QUERIES[name](spark, SF_DIR)))
        return sum(text.count(f"{table}.parquet") for text in reads)

    assert scans("quality_report", "lineitem") <= 2
    assert scans("nba_documents", "conversations") <= 3  # one of them reads the numbers only
    assert scans("nba_documents", "lineitem") <= 2
    assert scans("text_search", "documents") <= 1
    assert scans("customer_list", "events") == 0
