"""Change, severity, direction and band rules.

Arguments are column names or SQL expressions. Each rule is one SQL expression,
so a wide product is built in few calls and reads like the rule it states.
Money and scores are decimals, so every threshold compares exact values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent above which a change is MAJOR / MODERATE, per field.
THRESHOLDS: dict[str, tuple[int, int]] = {
    "premium": (15, 5),
    "deductible": (50, 20),
    "building": (20, 10),
    "contents": (20, 10),
    "flood_cov": (20, 10),
    "flood_ded": (50, 20),
}
# Fields where zero or absent on both sides counts as UNCHANGED.
ZERO_GUARDED = ("flood_cov", "flood_ded")
SEVERITIES = ("UNCHANGED", "MINOR", "MODERATE", "MAJOR")

# Lowest churn score of each band.
CHURN_BANDS = (("HIGH", "0.7"), ("MODERATE", "0.4"), ("LOW", "0.2"))
CHURN_FLOOR = "MINIMAL"


def churn_label(score: str) -> Column:
    bands = " ".join(f"WHEN {score} >= {lowest} THEN '{name}'" for name, lowest in CHURN_BANDS)
    return F.expr(f"CASE {bands} ELSE '{CHURN_FLOOR}' END")


def percent_sql(old: str, new: str) -> str:
    """Unrounded percent; NULL when the base is zero or either side is NULL."""
    return f"(({new} - {old}) / nullif({old}, 0) * 100)"


def percent_change(old: str, new: str) -> Column:
    return F.expr(f"round({percent_sql(old, new)}, 1)")


def severity(old: str, new: str, field: str) -> Column:
    """Size of a change regardless of its sign, from the unrounded percent.

    A value added to a zero base has no percent and is MINOR; a NULL side
    decides nothing and is UNCHANGED.
    """
    major, moderate = THRESHOLDS[field]
    size = f"abs({percent_sql(old, new)})"
    absent = ""
    if field in ZERO_GUARDED:
        absent = f"WHEN coalesce({old}, 0) = 0 AND coalesce({new}, 0) = 0 THEN 'UNCHANGED'"
    return F.expr(
        f"CASE {absent} WHEN {size} > {major} THEN 'MAJOR' WHEN {size} > {moderate} THEN 'MODERATE' "
        f"WHEN {new} != {old} THEN 'MINOR' ELSE 'UNCHANGED' END"
    )


def worst(severities: list[str], floor: str = "UNCHANGED") -> Column:
    """Worst of several severities, never below ``floor``."""
    above = SEVERITIES[SEVERITIES.index(floor) + 1 :]
    levels = " ".join(f"WHEN '{x}' IN ({', '.join(severities)}) THEN '{x}'" for x in reversed(above))
    return F.expr(f"CASE {levels} ELSE '{floor}' END")


def differs(old: str, new: str) -> Column:
    """TRUE only when both sides are known and unequal."""
    return F.expr(f"coalesce({old} != {new}, false)")


def risk_rank_sql(level: str) -> str:
    return f"CASE {level} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def risk_direction(old: str, new: str) -> Column:
    """UP / DOWN / UNCHANGED of a rating. A missing rating ranks lowest, and two
    ratings that are not known to be equal never count as UNCHANGED."""
    return F.expr(
        f"CASE WHEN {old} = {new} THEN 'UNCHANGED' "
        f"WHEN {risk_rank_sql(new)} > {risk_rank_sql(old)} THEN 'UP' ELSE 'DOWN' END"
    )


def score_direction(old: str, new: str) -> Column:
    return F.expr(
        f"CASE WHEN {new} > {old} THEN 'INCREASED' WHEN {new} < {old} THEN 'DECREASED' ELSE 'UNCHANGED' END"
    )


def item_list(text: str) -> Column:
    """Comma-separated text as a sorted array of trimmed lower-case items."""
    items = f"transform(split(lower(coalesce({text}, '')), ','), x -> trim(x))"
    return F.expr(f"array_sort(array_distinct(filter({items}, x -> x != '')))")


def sentiment_label(score: str) -> Column:
    # Lower bounds of the tone bands. An unknown score takes the last one.
    return F.expr(
        f"CASE WHEN {score} > 0.3D THEN 'Positive' WHEN {score} > 0D THEN 'Neutral' "
        f"WHEN {score} > -0.3D THEN 'Mildly Concerned' WHEN {score} > -0.6D THEN 'Concerned' "
        "ELSE 'Very Negative' END"
    )


def retention_risk(churn_signal: str, sentiment: str) -> Column:
    return F.expr(
        f"CASE WHEN {churn_signal} = 'high' THEN 'HIGH' "
        f"WHEN {churn_signal} = 'moderate' OR {sentiment} < -0.3D THEN 'ELEVATED' "
        f"WHEN {churn_signal} = 'low' OR {sentiment} < 0D THEN 'LOW' ELSE 'MINIMAL' END"
    )
