"""Reading JSON written by a model: parse, fall back, default field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field name, type, value used when the text cannot be parsed.
SIGNAL_FIELDS = (
    ("urgency", "string", "medium"),
    ("churn_signal", "string", "unknown"),
    ("pricing_concern", "boolean", False),
    ("coverage_concern", "boolean", False),
    ("complaint_signal", "boolean", False),
    ("key_phrases", "array<string>", None),
    ("recommended_tone", "string", "empathetic"),
    ("customer_emotion", "string", "unknown"),
)

RECOMMENDATION_SCHEMA = (
    "struct<recommended_action:struct<code:string,title:string,description:string,priority:string>,"
    "why_this_action:string,evidence:array<string>,"
    "alternative_actions:array<struct<code:string,title:string,why_not_selected:string>>,"
    "agent_talking_points:array<string>,risk_flags:array<string>>"
)

# The recommendation used when no response can be parsed.
FALLBACK_ACTION = {
    "code": "B",
    "title": "Explain changes and recommend renewal",
    "description": "Review the renewal changes with the customer and recommend proceeding.",
    "priority": "MEDIUM",
}
FALLBACK_WHY = "Fallback recommendation — AI response could not be parsed."
FALLBACK_EVIDENCE = ("Fallback due to parsing failure",)
FALLBACK_POINTS = ("Review the policy changes with the customer",)
FALLBACK_FLAGS = ("AI parsing failed — review recommendation manually",)

# What a reader shows for fields absent from a parsed response.
READ_DEFAULTS = {"code": "?", "title": "No recommendation", "description": "", "priority": "MEDIUM"}


def failed(raw: Column) -> Column:
    """TRUE when there is text and it is not JSON. Absent or blank text is not a failure."""
    return raw.isNotNull() & (F.trim(raw) != "") & F.try_parse_json(raw).isNull()


def with_signals(df: DataFrame, raw: str, out: str = "signals") -> DataFrame:
    """Add the signals struct read from model responses in column ``raw``.

    Unparseable text gives the full default record with the text kept; valid
    JSON that lacks a field leaves just that field NULL. The text is parsed once,
    in a projection of its own.
    """
    fields = []
    for name, kind, default in SIGNAL_FIELDS:
        value = F.try_variant_get("_parsed", f"$.{name}", kind)
        fallback = F.array().cast(kind) if default is None else F.lit(default)
        fields.append(F.when(F.col("_bad"), fallback).otherwise(value).alias(name))
    struct = F.struct(
        *fields, F.col("_bad").alias("parse_error"), F.when(F.col("_bad"), F.col(raw)).alias("raw_output")
    )
    return _parsed_once(df, raw).withColumn(out, struct).drop("_parsed", "_bad")


def _parsed_once(df: DataFrame, raw: str) -> DataFrame:
    bad = F.col("_parsed").isNull() & F.coalesce(F.trim(F.col(raw)) != "", F.lit(False))
    return df.withColumn("_parsed", F.try_parse_json(raw)).withColumn("_bad", bad)


def fallback_recommendation() -> Column:
    def texts(values: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in FALLBACK_ACTION.items()]).alias("recommended_action"),
        F.lit(FALLBACK_WHY).alias("why_this_action"),
        texts(FALLBACK_EVIDENCE).alias("evidence"),
        F.array().cast("array<struct<code:string,title:string,why_not_selected:string>>").alias(
            "alternative_actions"
        ),
        texts(FALLBACK_POINTS).alias("agent_talking_points"),
        texts(FALLBACK_FLAGS).alias("risk_flags"),
    ).cast(RECOMMENDATION_SCHEMA)


def with_recommendation(df: DataFrame, primary: str, retry: str, out: str = "nba") -> DataFrame:
    """Add the recommendation read from two responses: the first that parses, else the
    fallback record; gaps are filled for readers.

    ``from_json`` gives NULL fields rather than NULL on bad text, so the choice
    is gated on the parse itself. A retry is only looked at after a failure.
    Every step is a projection of its own, so nothing is parsed per output field.
    """
    first, second = F.col("_first_bad"), failed(F.col(retry)) | F.col(retry).isNull()
    chosen = (
        df.withColumn("_first_bad", F.coalesce(failed(F.col(primary)), F.lit(False)))
        .withColumn("_bad", first & second)
        .withColumn("_text", F.when(first, F.col(retry)).otherwise(F.col(primary)))
        .withColumn(
            "_read",
            F.when(F.col("_bad"), fallback_recommendation()).otherwise(
                F.from_json("_text", RECOMMENDATION_SCHEMA)
            ),
        )
    )
    action = ", ".join(
        f"'{name}', coalesce(_read.recommended_action.{name}, '{default}')" for name, default in READ_DEFAULTS.items()
    )
    no_texts = "cast(array() AS array<string>)"
    no_actions = "cast(array() AS array<struct<code:string,title:string,why_not_selected:string>>)"
    nba = F.expr(
        f"named_struct('recommended_action', named_struct({action}), "
        "'why_this_action', coalesce(_read.why_this_action, ''), "
        f"'evidence', coalesce(_read.evidence, {no_texts}), "
        f"'alternative_actions', coalesce(_read.alternative_actions, {no_actions}), "
        f"'agent_talking_points', coalesce(_read.agent_talking_points, {no_texts}), "
        f"'risk_flags', coalesce(_read.risk_flags, {no_texts}), "
        f"'parse_error', _bad, 'raw_output', CASE WHEN _bad THEN coalesce({retry}, {primary}) END)"
    )
    return chosen.withColumn(out, nba).drop("_first_bad", "_bad", "_text", "_read")
