"""Successive risk assessments: change, cause, effect on the renewal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.rules import percent_change, risk_direction, score_direction, worst
from ..sources.tables import Tables
from .customer360 import HOT_ROWS, join_repeated, top_per_key
from .policy import compare_terms, requested_customers

DIMENSIONS = ("flood", "fire", "earthquake")

# change column suffix -> history column, in output order
ASSESSMENT = {
    "assessment_id": "risk_assessment_id",
    "assessment_date": "assessment_date",
    "flood_risk": "flood_risk",
    "fire_risk": "fire_risk",
    "earthquake_risk": "earthquake_risk",
    "risk_score": "overall_risk_score",
    "risk_reason": "risk_reason",
}


def newest_two(risk_history: DataFrame) -> DataFrame:
    newest = [F.desc("assessment_date"), F.desc("risk_assessment_id")]
    return top_per_key(risk_history, ["property_id"], newest, n=2)


def assessment_pairs(ranked: DataFrame) -> DataFrame:
    """Ranked rows folded to previous and current columns per property; ``assessments``
    is 1 where there is no previous one.

    The ranking already placed a property's two rows in one partition, so this
    aggregation adds no shuffle and no self-join.
    """
    columns = [
        F.expr(f"max({source}) FILTER (WHERE rn = {rank})").alias(f"{prefix}_{suffix}")
        for prefix, rank in (("prev", 2), ("curr", 1))
        for suffix, source in ASSESSMENT.items()
    ]
    return ranked.groupBy("property_id").agg(*columns, F.max("rn").alias("assessments"))


def directions() -> list[Column]:
    old, new = "prev_risk_score", "curr_risk_score"
    return [
        *[risk_direction(f"prev_{d}_risk", f"curr_{d}_risk").alias(f"{d}_direction") for d in DIMENSIONS],
        F.expr(f"{new} - {old}").alias("risk_score_change"),
        percent_change(old, new).alias("risk_score_change_pct"),
        score_direction(old, new).alias("overall_direction"),
    ]


def assessed_homes(tables: Tables) -> DataFrame:
    """Every assessed home with its newest two assessments; ``current_risk`` is set where
    there is only one, the directions where there are two."""
    homes = tables["property"].select("property_id", "customer_id", "location", "property_type")
    pairs = assessment_pairs(newest_two(tables["risk_history"]))
    changed = F.col("assessments") == 2
    snapshot = F.struct(
        *[F.col(f"curr_{d}_risk").alias(f"{d}_risk") for d in DIMENSIONS],
        F.col("curr_risk_score").alias("overall_risk_score"),
        F.col("curr_assessment_date").alias("assessment_date"),
        F.col("curr_risk_reason").alias("risk_reason"),
    )
    graded = pairs.select("*", *directions(), F.when(~changed, snapshot).alias("current_risk"))
    return graded.select(
        *pairs.columns, "current_risk", *[F.when(changed, F.col(c)).alias(c) for c in DIRECTION_COLUMNS]
    ).join(homes, "property_id")


DIRECTION_COLUMNS = [
    *[f"{d}_direction" for d in DIMENSIONS], "risk_score_change", "risk_score_change_pct", "overall_direction"
]
CHANGE_COLUMNS = [
    "customer_id", "property_id", "location", "property_type",
    *[f"{p}_{s}" for p in ("prev", "curr") for s in ASSESSMENT],
    *DIRECTION_COLUMNS,
]


def home_changes(tables: Tables) -> DataFrame:
    """Homes with two or more assessments."""
    return assessed_homes(tables).filter("assessments = 2").select(*CHANGE_COLUMNS)


def risk_change(tables: Tables) -> DataFrame:
    """The changes with the customer's name; homes of unknown customers are left out."""
    names = tables["customer"].select("customer_id", "name")
    return home_changes(tables).join(names, "customer_id").select("customer_id", "name", *CHANGE_COLUMNS[1:])


def causal_chain() -> Column:
    lines = [
        f"CASE WHEN {d}_direction != 'UNCHANGED' THEN "
        f"concat('{d.capitalize()} risk changed from ', prev_{d}_risk, ' to ', curr_{d}_risk) END"
        for d in DIMENSIONS
    ]
    overall = (
        "concat('Overall risk score changed from ', string(prev_risk_score), ' to ', string(curr_risk_score), "
        "' (', CASE WHEN risk_score_change > 0 THEN '+' ELSE '' END, string(risk_score_change_pct), '%)')"
    )
    return F.expr(f"array_compact(array({', '.join([*lines, overall])}))")


def communication_points() -> Column:
    points = [
        texts.quoted(text) if d is None else f"CASE WHEN {d}_direction = 'UP' THEN {texts.quoted(text)} END"
        for d, text in texts.COMMUNICATION_POINTS
    ]
    return F.expr(f"array_compact(array({', '.join(points)}))")


def policy_impact() -> Column:
    """Effect on the renewal; its severity looks at three fields and is never below MINOR."""
    three = [f"{stem}_severity" for stem in ("premium", "flood_cov", "flood_ded")]
    compared = F.col("overall_severity").isNotNull()
    return F.struct(
        "premium_change_pct",
        "premium_change",
        F.col("flood_cov_change_pct").alias("flood_coverage_change_pct"),
        F.col("flood_cov_change").alias("flood_coverage_change"),
        F.col("flood_ded_change_pct").alias("flood_deductible_change_pct"),
        F.col("flood_ded_change").alias("flood_deductible_change"),
        "exclusions_changed",
        F.when(compared, worst(three, floor="MINOR")).alias("overall_severity"),
        F.when(compared, F.col("policy_id")).alias("policy_id"),
        F.when(~compared, texts.NO_POLICY_IMPACT).alias("message"),
    )


def _assessment_sql(prefix: str) -> str:
    risks = ", ".join(f"'{d}_risk', {prefix}_{d}_risk" for d in DIMENSIONS)
    return (
        f"named_struct('assessment_id', {prefix}_assessment_id, 'assessment_date', {prefix}_assessment_date, "
        f"{risks}, 'overall_risk_score', {prefix}_risk_score, 'risk_reason', {prefix}_risk_reason)"
    )


def _changes_sql() -> str:
    blocks = ", ".join(
        f"'{d}', named_struct('previous', prev_{d}_risk, 'current', curr_{d}_risk, 'direction', {d}_direction)"
        for d in DIMENSIONS
    )
    return (
        f"named_struct({blocks}, 'overall_score', named_struct('previous', prev_risk_score, "
        "'current', curr_risk_score, 'change', risk_score_change, 'change_pct', risk_score_change_pct, "
        "'direction', overall_direction))"
    )


def risk_document() -> Column:
    """The document of one customer over requests left-joined to a comparison row and an
    assessed home, either of which may be absent."""
    cases = (
        ("known IS NULL", "not_found", texts.CUSTOMER_NOT_FOUND),
        ("overall_direction IS NOT NULL", "ok", None),
        ("current_risk IS NOT NULL", "no_risk_change", texts.NO_RISK_CHANGE),
        ("true", "no_risk_data", texts.NO_RISK_DATA),
    )
    status = " ".join(f"WHEN {condition} THEN '{name}'" for condition, name, _ in cases)
    message = " ".join(f"WHEN {condition} THEN {texts.quoted(text)}" for condition, _, text in cases)
    changed = F.col("overall_direction").isNotNull()
    return F.struct(
        F.expr(f"CASE {status} END").alias("status"),
        "customer_id",
        "customer_name",
        F.expr(f"CASE {message} END").alias("message"),
        F.when(changed, F.col("property_id")).alias("property_id"),
        F.when(changed, F.col("location")).alias("location"),
        F.when(changed, F.col("property_type")).alias("property_type"),
        F.when(changed, F.expr(_assessment_sql("prev"))).alias("previous_assessment"),
        F.when(changed, F.expr(_assessment_sql("curr"))).alias("current_assessment"),
        F.when(changed, F.expr(_changes_sql())).alias("changes"),
        F.when(changed, F.col("curr_risk_reason")).alias("root_cause"),
        F.when(changed, causal_chain()).alias("causal_chain"),
        F.when(changed, policy_impact()).alias("policy_impact"),
        F.when(changed, communication_points()).alias("communication_points"),
        "current_risk",
    )


IMPACT_COLUMNS = [
    "policy_id", "overall_severity", "exclusions_changed",
    *[f"{s}_{x}" for s in ("premium", "flood_cov", "flood_ded") for x in ("change", "change_pct", "severity")],
]


def analyze_risk(tables: Tables, requests: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(customer_id, status, doc) for every requested customer.

    A customer with several changed homes gets one document per home; customers
    without any change get their latest single assessments. The effect on the
    renewal is that of the customer's comparable policy with the smallest id,
    which it names: homes and policies are not related any closer, and
    ``compare_policy`` has all policies. Customers with more than ``hot_rows``
    homes are spread (None: there are none).
    """
    terms = top_per_key(
        compare_terms(tables["policy_version"]).select("customer_id", *IMPACT_COLUMNS), ["customer_id"], [F.asc("policy_id")]
    ).drop("rn")
    asked = requested_customers(tables, requests.select("customer_id")).join(terms, "customer_id", "left")
    assessed = assessed_homes(tables)
    # A single assessment only speaks for a customer without any changed home.
    most = assessed.groupBy("customer_id").agg(F.max("assessments").alias("most"))
    homes = assessed.join(most, "customer_id").filter("assessments = 2 OR most = 1").drop("most", "assessments")
    joined = join_repeated(asked, homes, "customer_id", "property_id", hot_rows)
    return joined.select("customer_id", risk_document().alias("doc")).select(
        "customer_id", F.col("doc.status").alias("status"), "doc"
    )
