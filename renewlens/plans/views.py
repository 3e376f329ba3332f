"""The table products as views for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.actions import action_history
from ..operators.customer360 import customer_360
from ..operators.policy import policy_comparison
from ..operators.risk import risk_change
from ..sources.tables import Tables


def products(tables: Tables) -> dict[str, DataFrame]:
    return {
        "v_customer_360": customer_360(tables, hot_rows=None),
        "v_policy_comparison": policy_comparison(tables),
        "v_risk_change": risk_change(tables),
        "v_action_history": action_history(tables["action_log"], tables["customer"]),
    }


def register_products(tables: Tables) -> None:
    """Plain views: nothing is computed until one is queried."""
    for name, df in products(tables).items():
        df.createOrReplaceTempView(name)
