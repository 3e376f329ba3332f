"""Contracts of the seven tables: schemas, keys, value domains, text lengths."""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()
_DATE = T.DateType()
_INT = T.IntegerType()
_NTZ = T.TimestampNTZType()
_MONEY = T.DecimalType(12, 2)
_SCORE = T.DecimalType(3, 2)


def _schema(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3) for c in columns])


REQUIRED = "required"

CUSTOMER = _schema(
    ("customer_id", _STR, REQUIRED),
    ("name", _STR, REQUIRED),
    ("age", _INT),
    ("tenure_years", T.DecimalType(4, 1)),
    ("customer_value", _MONEY),
    ("payment_history", _STR),
    ("churn_risk_score", _SCORE),
)
PROPERTY = _schema(
    ("property_id", _STR, REQUIRED),
    ("customer_id", _STR, REQUIRED),
    ("property_type", _STR),
    ("location", _STR),
    ("building_age", _INT),
    ("construction_type", _STR),
)
POLICY_VERSION = _schema(
    ("policy_id", _STR, REQUIRED),
    ("customer_id", _STR, REQUIRED),
    ("policy_version", _STR, REQUIRED),
    ("policy_type", _STR),
    ("policy_status", _STR),
    ("effective_date", _DATE),
    ("expiry_date", _DATE),
    ("annual_premium", _MONEY),
    ("deductible", _MONEY),
    ("building_coverage", _MONEY),
    ("contents_coverage", _MONEY),
    ("flood_coverage", _MONEY),
    ("flood_deductible", _MONEY),
    ("exclusions", _STR),
    ("renewal_date", _DATE),
)
RISK_HISTORY = _schema(
    ("risk_assessment_id", _STR, REQUIRED),
    ("property_id", _STR, REQUIRED),
    ("assessment_date", _DATE, REQUIRED),
    ("flood_risk", _STR),
    ("fire_risk", _STR),
    ("earthquake_risk", _STR),
    ("overall_risk_score", _SCORE),
    ("risk_reason", _STR),
)
CLAIM = _schema(
    ("claim_id", _STR, REQUIRED),
    ("customer_id", _STR, REQUIRED),
    ("policy_id", _STR),
    ("claim_type", _STR),
    ("claim_status", _STR),
    ("claim_amount", _MONEY),
    ("claim_date", _DATE),
)
INTERACTION = _schema(
    ("interaction_id", _STR, REQUIRED),
    ("customer_id", _STR, REQUIRED),
    ("interaction_type", _STR),
    ("interaction_timestamp", _NTZ),
    ("raw_transcript", _STR),
    ("agent_note", _STR),
)
ACTION_LOG = _schema(
    ("action_id", _STR, REQUIRED),
    ("customer_id", _STR, REQUIRED),
    ("interaction_id", _STR),
    ("recommended_action", _STR),
    ("action_taken", _STR),
    ("action_timestamp", _NTZ),
    ("status", _STR),
)

SCHEMAS: dict[str, T.StructType] = {
    "customer": CUSTOMER,
    "property": PROPERTY,
    "policy_version": POLICY_VERSION,
    "risk_history": RISK_HISTORY,
    "claim": CLAIM,
    "interaction": INTERACTION,
    "action_log": ACTION_LOG,
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customer": ("customer_id",),
    "property": ("property_id",),
    "policy_version": ("policy_id", "policy_version"),
    "risk_history": ("risk_assessment_id",),
    "claim": ("claim_id",),
    "interaction": ("interaction_id",),
    "action_log": ("action_id",),
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("property", "customer_id", "customer", "customer_id"),
    ("policy_version", "customer_id", "customer", "customer_id"),
    ("claim", "customer_id", "customer", "customer_id"),
    ("interaction", "customer_id", "customer", "customer_id"),
    ("risk_history", "property_id", "property", "property_id"),
)

# The codes each column may hold.
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH")
DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "customer": {"payment_history": ("EXCELLENT", "GOOD", "FAIR", "POOR")},
    "property": {
        "property_type": ("SINGLE_FAMILY", "CONDO", "TOWNHOME"),
        "construction_type": ("WOOD_FRAME", "BRICK", "CONCRETE", "MIXED"),
    },
    "policy_version": {
        "policy_version": ("CURRENT", "RENEWAL", "HISTORICAL"),
        "policy_status": ("ACTIVE", "PROPOSED", "LAPSED", "CANCELLED"),
    },
    "risk_history": {
        "flood_risk": RISK_LEVELS,
        "fire_risk": RISK_LEVELS,
        "earthquake_risk": RISK_LEVELS,
    },
    "claim": {
        "claim_type": ("FLOOD", "FIRE", "THEFT", "LIABILITY", "OTHER"),
        "claim_status": ("OPEN", "CLOSED", "DENIED"),
    },
    "interaction": {"interaction_type": ("CALL", "EMAIL", "CHAT", "NOTE")},
    "action_log": {"status": ("PENDING", "EXECUTED", "DECLINED", "ESCALATED")},
}

# The declared text lengths.
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "customer": {"customer_id": 20, "name": 100, "payment_history": 20},
    "property": {"property_id": 20, "customer_id": 20, "property_type": 30, "location": 100, "construction_type": 30},
    "policy_version": {
        "policy_id": 20, "customer_id": 20, "policy_version": 20, "policy_type": 30, "policy_status": 20, "exclusions": 500,
    },
    "risk_history": {
        "risk_assessment_id": 20, "property_id": 20, "flood_risk": 10, "fire_risk": 10, "earthquake_risk": 10, "risk_reason": 500,
    },
    "claim": {"claim_id": 20, "customer_id": 20, "policy_id": 20, "claim_type": 30, "claim_status": 20},
    "interaction": {
        "interaction_id": 20, "customer_id": 20, "interaction_type": 20, "raw_transcript": 5000, "agent_note": 2000,
    },
    "action_log": {
        "action_id": 40, "customer_id": 20, "interaction_id": 20, "recommended_action": 16000, "action_taken": 4000, "status": 20,
    },
}
