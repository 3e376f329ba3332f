"""Co-located tables and packed keys: the same rows, without exchanges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from renewlens.operators import quality
from renewlens.operators.customer360 import customer_360
from renewlens.sources import bucketed, sales
from renewlens.session import shared_folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def setting(spark):
    yield
    spark.conf.unset(bucketed.SETTING)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_context_is_joined_without_an_exchange(spark, setting):
    tables = sales.sales_tables(spark, SF_DIR)
    held = bucketed.read_bucketed(spark, bucketed.write_bucketed(tables, shared_folder(spark, "buckets"), 4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
    try:
        df = customer_360(held, hot_rows=None)
        assert "Exchange" not in plan(df) and plan(df).count("Join ") == 6
        assert plan(customer_360(tables, hot_rows=None)).count("Exchange hashpartitioning") >= 6
        assert rows(df) == rows(customer_360(tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_table_is_not_bucketed(spark, setting):
    tables = dict(sales.sales_tables(spark, SF_DIR))
    customer = tables["customer"].agg(F.min("customer_id")).first()[0]
    tables["claim"] = tables["claim"].withColumn("customer_id", F.when(F.col("claim_id") % 3 == 0, customer).otherwise(F.col("customer_id")).cast("long"))
    most = tables["claim"].count() // 6
    names = bucketed.write_bucketed(tables, shared_folder(spark, "buckets"), 4, hot_rows=most)
    held = bucketed.read_bucketed(spark, names)
    bucket = lambda name: [r for r in spark.sql(f"DESCRIBE EXTENDED {names[name]}").collect() if r["col_name"] == "Num Buckets"]
    assert not bucket("claim") and bucket("customer")[0]["data_type"] == "4"
    assert rows(customer_360(held, hot_rows=None)) == rows(customer_360(tables))


def test_orphans_of_homes_nobody_knows(spark, setting):
    tables = dict(sales.sales_tables(spark, SF_DIR))
    tables["property"] = tables["property"].filter("property_id % 5 <> 0")
    held = bucketed.read_bucketed(spark, bucketed.write_bucketed(tables, shared_folder(spark, "buckets"), 4))
    assert rows(customer_360(held, hot_rows=None)) == rows(customer_360(tables))
    assert rows(quality.fk_orphans(held)) == rows(quality.fk_orphans(tables))


KEYS = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 2**31, 2**63 - 1, None]


def family(spark, held, asked, kind="long"):
    """Tables whose every foreign key column holds ``asked`` over parents ``held``."""
    frame = lambda values, *names: spark.createDataFrame([(v,) * len(names) for v in values], ", ".join(f"{n} {kind}" for n in names))
    children = {child: frame(asked, column) for child, column, _, _ in quality.FOREIGN_KEYS}
    both = spark.createDataFrame([(a, h) for a, h in zip(asked, (held * len(asked))[: len(asked)])], f"customer_id {kind}, property_id {kind}")
    return {**children, "customer": frame(held, "customer_id"), "property": both}


@pytest.mark.parametrize("slots", [quality.BROADCAST_SLOTS, 2])
def test_packed_keys_are_exact(spark, slots):
    tables = family(spark, [k for k in KEYS if k is None or k % 2 == 0], KEYS + [64, 65, 65, None])
    assert rows(quality.fk_orphans_filtered(tables, slots)) == rows(quality.fk_orphans(tables))


def test_text_keys_are_compared_as_ever(spark):
    tables = family(spark, ["a", "b"], ["a", "c", None, "c"], "string")
    found = rows(quality.fk_orphans_filtered(tables))
    assert found == rows(quality.fk_orphans(tables)) and "orphans=3" in found[0]


def test_children_are_not_exchanged(spark):
    """A third of all children belong to one parent; what is exchanged is a row per task and the packed parents."""
    parents = spark.range(20_000).withColumnRenamed("id", "customer_id")
    children = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_100).alias("customer_id"))
    tables = family(spark, [1], [1]) | {"customer": parents, "claim": children}
    tables |= {n: children.limit(0) for n in ("policy_version", "interaction")}
    assert quality.packed_keys(parents, "customer_id").count() == 313
    df = quality.fk_orphans_filtered(tables)
    text = plan(df)
    assert "Exchange hashpartitioning(customer_id" not in text and "Exchange hashpartitioning(key" not in text and "BroadcastExchange" in text
    assert {r["child"]: r["orphans"] for r in df.collect()}["claim"] == children.filter("customer_id >= 20000").count()
