"""The seven tables co-located by customer, so that the context is joined without an exchange.

Every table is written in the same number of buckets by customer and sorted within them. Assessments take the
customer of their home along. A table in which one customer holds very many rows
would put them all into one bucket; it is written without buckets, and Spark exchanges it as ever.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.customer360 import HOT_ROWS, hot_keys
from .tables import Tables

KEY = "customer_id"
#: Joins on (customer, home) use the buckets by customer; changes plans, never results.
SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def with_customers(tables: Tables) -> dict[str, DataFrame]:
    """The tables with the customer of every assessment's home; assessments of unknown homes have none."""
    owners = tables["property"].select("property_id", KEY)
    return {**{name: tables[name] for name in tables}, "risk_history": tables["risk_history"].join(owners, "property_id", "left")}


def write_bucketed(tables: Tables, folder: str, buckets: int, hot_rows: int = HOT_ROWS) -> dict[str, str]:
    """Write all tables below ``folder``; returns the catalog name of each. ``folder`` has to be new."""
    mark, names = uuid.uuid4().hex[:12], {}
    for name, df in with_customers(tables).items():
        writer = df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
        if not hot_keys(df, KEY, hot_rows).isEmpty():
            writer = df.write
        names[name] = f"renewlens_{name}_{mark}"
        writer.option("path", f"{folder}/{name}").saveAsTable(names[name])
    return names


def read_bucketed(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """The tables under their catalog names, for ``customer_360`` and all other products."""
    spark.conf.set(SETTING, "false")
    return {name: spark.table(table) for name, table in names.items()}
