"""Current against renewal policy terms: comparison, documents, findings, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display, texts
from ..functions.rules import (
    THRESHOLDS,
    differs,
    item_list,
    percent_change,
    severity,
    worst,
)
from ..sources.tables import Tables
from .customer360 import HOT_ROWS, join_repeated

# comparison stem -> policy column, in output order
MEASURES = {
    "premium": "annual_premium",
    "deductible": "deductible",
    "building": "building_coverage",
    "contents": "contents_coverage",
    "flood_cov": "flood_coverage",
    "flood_ded": "flood_deductible",
}
OTHERS = {"exclusions": "exclusions", "effective": "effective_date", "expiry": "expiry_date"}
SIDES = {"cur": "CURRENT", "ren": "RENEWAL"}

# document block -> comparison stem
BLOCKS = {
    "premium": "premium",
    "deductible": "deductible",
    "building_coverage": "building",
    "contents_coverage": "contents",
    "flood_coverage": "flood_cov",
    "flood_deductible": "flood_ded",
}
REPORT_FIELDS = {
    "premium": "Annual Premium",
    "deductible": "General Deductible",
    "building": "Building Coverage",
    "contents": "Contents Coverage",
    "flood_cov": "Flood Coverage",
    "flood_ded": "Flood Deductible",
}


def policy_pivot(policy_version: DataFrame) -> DataFrame:
    """Both versions of a policy side by side, for policies that have both.

    One hash-partitioned aggregation with map-side combine; neither a self-join
    nor a distinct count is needed to know that both versions are present.
    """
    picked = [
        F.expr(f"max({column}) FILTER (WHERE policy_version = '{name}')").alias(f"{prefix}_{stem}")
        for prefix, name in SIDES.items()
        for stem, column in {**MEASURES, **OTHERS}.items()
    ]
    present = [F.expr(f"bool_or(policy_version = '{name}')").alias(f"has_{p}") for p, name in SIDES.items()]
    return (
        policy_version.filter(F.col("policy_version").isin(*SIDES.values()))
        .groupBy("customer_id", "policy_id")
        .agg(*picked, *present)
        .filter("has_cur AND has_ren")
        .drop("has_cur", "has_ren")
    )


def compare_terms(policy_version: DataFrame) -> DataFrame:
    """Change, percent and severity of every field per (customer, policy)."""
    fields: list[Column | str] = []
    for stem in MEASURES:
        cur, ren = f"cur_{stem}", f"ren_{stem}"
        fields += [
            cur,
            ren,
            F.expr(f"{ren} - {cur}").alias(f"{stem}_change"),
            percent_change(cur, ren).alias(f"{stem}_change_pct"),
            severity(cur, ren, stem).alias(f"{stem}_severity"),
        ]
    graded = policy_pivot(policy_version).select(
        "customer_id", "policy_id", *fields,
        "cur_exclusions", "ren_exclusions",
        differs("cur_exclusions", "ren_exclusions").alias("exclusions_changed"),
        "cur_effective", "cur_expiry", "ren_effective", "ren_expiry",
        item_list("cur_exclusions").alias("cur_items"),
        item_list("ren_exclusions").alias("ren_items"),
    )
    return graded.select(
        *[c for c in graded.columns if not c.endswith("_items")],
        worst([f"{stem}_severity" for stem in THRESHOLDS]).alias("overall_severity"),
        F.array_except("ren_items", "cur_items").alias("exclusions_added"),
        F.array_except("cur_items", "ren_items").alias("exclusions_removed"),
    )


def policy_comparison(tables: Tables) -> DataFrame:
    """The compared terms with the customer's name; policies of unknown customers are left out."""
    names = tables["customer"].select("customer_id", "name")
    terms = compare_terms(tables["policy_version"])
    return terms.join(names, "customer_id").select("customer_id", "name", *terms.columns[1:])


def finding_sql(stem: str) -> str:
    """One sentence about a changed field; NULL when unchanged or without a percent."""
    change = f"{stem}_change"
    parts = [
        texts.quoted(texts.FINDING_SUBJECTS[stem] + " "),
        f"CASE WHEN {change} > 0 THEN 'increased' ELSE 'decreased' END",
        "' by '",
        f"string(abs({stem}_change_pct))",
        "'%'",
    ]
    if stem == "premium":
        parts += ["' ($'", display.whole_sql(f"abs({change})"), "'/year)'"]
    return f"CASE WHEN {change} != 0 THEN concat({', '.join(parts)}) END"


def key_findings() -> Column:
    changed = f"CASE WHEN exclusions_changed THEN {texts.quoted(texts.EXCLUSIONS_CHANGED)} END"
    lines = [*[finding_sql(stem) for stem in MEASURES], changed]
    return F.expr(f"array_compact(array({', '.join(lines)}))")


def policy_document() -> Column:
    """The document of one customer over requests left-joined to a comparison row.

    Expects ``customer_id``, ``customer_name``, ``known`` (NULL for an unknown
    customer) and the comparison columns (NULL without a comparable renewal).
    """
    status = "CASE WHEN known IS NULL THEN 'not_found' WHEN overall_severity IS NULL THEN 'no_renewal' ELSE 'ok' END"
    message = (
        f"CASE WHEN known IS NULL THEN {texts.quoted(texts.CUSTOMER_NOT_FOUND)} "
        f"WHEN overall_severity IS NULL THEN {texts.quoted(texts.NO_RENEWAL)} END"
    )

    def when_ok(**fields: str) -> Column:
        inside = ", ".join(f"'{name}', {column}" for name, column in fields.items())
        return F.expr(f"CASE WHEN overall_severity IS NOT NULL THEN named_struct({inside}) END")

    blocks = [
        when_ok(
            current=f"cur_{stem}", renewal=f"ren_{stem}", change=f"{stem}_change",
            change_pct=f"{stem}_change_pct", severity=f"{stem}_severity",
        ).alias(block)
        for block, stem in BLOCKS.items()
    ]
    return F.struct(
        F.expr(status).alias("status"),
        "customer_id",
        "customer_name",
        F.expr(message).alias("message"),
        F.expr("CASE WHEN overall_severity IS NOT NULL THEN policy_id END").alias("policy_id"),
        *blocks,
        when_ok(
            current="cur_exclusions", renewal="ren_exclusions", changed="exclusions_changed",
            added="exclusions_added", removed="exclusions_removed",
        ).alias("exclusions"),
        when_ok(
            current_effective="cur_effective", current_expiry="cur_expiry",
            renewal_effective="ren_effective", renewal_expiry="ren_expiry",
        ).alias("dates"),
        "overall_severity",
        F.when(F.col("overall_severity").isNotNull(), key_findings()).alias("key_findings"),
    )


def requested_customers(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests with the customer's name; ``known`` is NULL for an unknown one."""
    known = tables["customer"].select(
        "customer_id", F.col("name").alias("customer_name"), F.lit(True).alias("known")
    )
    return requests.join(known, "customer_id", "left")


def compare_policy(tables: Tables, requests: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(customer_id, status, doc) for every requested customer.

    ``requests`` has one ``customer_id`` per row. A customer with several
    comparable policies gets one document per policy; customers with more than
    ``hot_rows`` of them are spread (None: there are none).
    """
    joined = join_repeated(
        requested_customers(tables, requests.select("customer_id")),
        compare_terms(tables["policy_version"]), "customer_id", "policy_id", hot_rows,
    )
    return joined.select("customer_id", policy_document().alias("doc")).select(
        "customer_id", F.col("doc.status").alias("status"), "doc"
    )


def renewal_report(comparison: DataFrame) -> DataFrame:
    """Six display rows per compared policy."""
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("field"),
            display.whole_money(f"coalesce(cur_{stem}, 0)").alias("current"),
            display.whole_money(f"coalesce(ren_{stem}, 0)").alias("renewal"),
            display.signed_money(f"{stem}_change").alias("change"),
            display.signed_percent(f"{stem}_change", f"{stem}_change_pct").alias("percent"),
            F.col(f"{stem}_severity").alias("severity"),
        )
        for position, (stem, label) in enumerate(REPORT_FIELDS.items())
    ]
    return comparison.select("customer_id", "policy_id", F.inline(F.array(*rows)))
