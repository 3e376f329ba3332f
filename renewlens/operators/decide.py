"""Next best action: context, prompts, scoring, ranking, explanation.

One row per request carries the whole context, so scoring and ranking the seven
candidates is row-local: no join with the menu, no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display, texts
from ..functions.model_json import with_recommendation
from ..sources.tables import Tables
from .customer360 import customer_360
from .policy import compare_terms, finding_sql, policy_document, requested_customers
from .risk import DIMENSIONS, assessed_homes, communication_points, risk_document

# The action menu.
MENU = {
    "A": "Explain renewal changes only",
    "B": "Explain changes and recommend standard renewal",
    "C": "Explain changes and offer alternative option",
    "D": "Recommend risk-reduction measures",
    "E": "Escalate to retention specialist",
    "F": "Escalate to underwriting specialist",
    "G": "Request additional property information",
}
DESCRIPTIONS = {
    "A": "Walk through what changes at renewal. No offer is made.",
    "B": "Walk through what changes and recommend renewing at the new terms.",
    "C": "Walk through what changes and offer another deductible or coverage mix to keep the premium in reach.",
    "D": "Agree on measures that lower the risk before the renewal is finalized.",
    "E": "Hand over to a retention specialist: the customer is valuable and likely to leave.",
    "F": "Hand over to underwriting: the risk or the coverage needs a specialist.",
    "G": "Ask for the missing property details before going on.",
}
CRITERIA = ("retention", "tone_fit", "risk_management", "satisfaction")

# Base points per criterion, 1 to 10, in the order of CRITERIA.
BASE = {
    "A": (3, 6, 6, 5),
    "B": (5, 6, 7, 6),
    "C": (7, 7, 6, 8),
    "D": (5, 5, 9, 6),
    "E": (8, 5, 5, 6),
    "F": (4, 5, 9, 5),
    "G": (3, 4, 7, 4),
}
# (fact, action, criterion, points added when the fact holds)
ADJUSTMENTS = (
    ("likely_to_leave", "E", "retention", 2),
    ("likely_to_leave", "E", "tone_fit", 3),
    ("likely_to_leave", "C", "retention", 1),
    ("likely_to_leave", "A", "retention", -2),
    ("major_change", "C", "satisfaction", 1),
    ("major_change", "C", "tone_fit", 1),
    ("major_change", "A", "satisfaction", -2),
    ("major_change", "B", "satisfaction", -1),
    ("small_change", "A", "tone_fit", 2),
    ("small_change", "B", "satisfaction", 2),
    ("risk_up", "D", "risk_management", 1),
    ("risk_up", "D", "tone_fit", 1),
    ("risk_up", "C", "tone_fit", 1),
    ("open_claim", "D", "tone_fit", 1),
    ("open_claim", "F", "risk_management", 1),
    ("open_claim", "F", "tone_fit", 2),
    ("many_claims_or_lapsed", "F", "retention", 1),
    ("many_claims_or_lapsed", "F", "tone_fit", 3),
    ("incomplete", "G", "tone_fit", 5),
    ("incomplete", "G", "risk_management", 2),
)
ESCALATION_VALUE = 7500
ALTERNATIVES = 2

CONTEXT_FIELDS = (
    "customer_id", "name", "age", "tenure_years", "customer_value", "payment_history", "churn_risk_score",
    "churn_risk_label", "property_id", "property_type", "location", "building_age", "construction_type", "policy_id",
    "policy_status", "annual_premium", "deductible", "building_coverage", "contents_coverage",
    "flood_coverage", "flood_deductible", "exclusions", "has_renewal_proposal", "total_claims", "open_claims",
    "total_claim_amount", "current_flood_risk", "current_fire_risk", "current_earthquake_risk",
    "current_risk_score",
)
# Without these the recommendation rests on gaps.
NEEDED_FIELDS = (
    "property_type", "location", "building_age", "construction_type",
    "current_flood_risk", "current_fire_risk", "current_earthquake_risk", "current_risk_score",
)


def default_requests(c360: DataFrame) -> DataFrame:
    """Every customer with the latest interaction."""
    return c360.select("customer_id", F.col("last_interaction_id").alias("interaction_id")).distinct()


def join_known(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join for a left side that has no ``key`` in very many rows.

    Rows without a key would all hash to one task; here they go by ``spread_by``. They match nothing either way.
    """
    place = F.xxhash64(F.col(key))
    spread = F.when(F.col(key).isNull(), F.xxhash64(F.col(spread_by))).otherwise(place)
    return left.withColumn("spread", spread).join(right.withColumn("spread", place), [key, "spread"], "left").drop("spread")


def nba_context(
    tables: Tables, requests: DataFrame, interaction_docs: DataFrame | None = None, holdings: str = "first"
) -> DataFrame:
    """One row per (customer_id, interaction_id) request with the four context parts.

    Each product is computed once and joined; the documents are then built from
    the joined columns. The home and the policy of a decision are chosen once,
    in the customer part, and the comparison and the risk change joined to it
    are those of that policy and that home. ``holdings`` = "all" trusts that
    there is nothing to choose from.
    """
    c360 = customer_360(tables, holdings, hot_rows=None).select(
        "customer_id", "property_id", "policy_id", F.struct(*CONTEXT_FIELDS).alias("customer_360")
    )
    joined = (
        requested_customers(tables, requests.select("customer_id", "interaction_id"))
        .join(c360, "customer_id", "left")
        .join(compare_terms(tables["policy_version"]), ["customer_id", "policy_id"], "left")
        .join(assessed_homes(tables).drop("location", "property_type"), ["customer_id", "property_id"], "left")
        .select("*", "customer_360.location", "customer_360.property_type")
    )
    nothing = F.struct(F.lit("no_interaction").alias("status"), F.lit(texts.NO_INTERACTION).alias("message"))
    if interaction_docs is None:
        return _flags(joined.withColumn("interaction_intelligence", nothing), talked=False)
    docs = interaction_docs.select("interaction_id", F.col("doc").alias("interaction_doc"))
    joined = join_known(joined, docs, "interaction_id", "customer_id")  # most customers have not talked
    schema = joined.schema["interaction_doc"].dataType
    empty = F.from_json(F.to_json(nothing), schema)
    return _flags(
        joined.withColumn("interaction_intelligence", F.coalesce("interaction_doc", empty)).drop("interaction_doc"),
        talked=True,
    )


def _any(conditions: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce({c}, false)" for c in conditions) + ")"


# Facts that scoring and explanation look at, over a context row.
FACTS = {
    "likely_to_leave": _any(["customer_360.churn_risk_label = 'HIGH'", "retention_risk = 'HIGH'"]),
    "major_change": "overall_severity = 'MAJOR'",
    "small_change": "overall_severity IN ('MINOR', 'UNCHANGED')",
    "risk_up": _any([f"{d}_direction = 'UP'" for d in DIMENSIONS]),
    "open_claim": "customer_360.open_claims > 0",
    "many_claims_or_lapsed": _any(["customer_360.total_claims >= 3", "customer_360.policy_status = 'LAPSED'"]),
    "incomplete": _any([f"customer_360.{f} IS NULL" for f in NEEDED_FIELDS]),
    "comparable": "overall_severity IS NOT NULL",
    "lapsed": "customer_360.policy_status = 'LAPSED'",
    "several_claims": "customer_360.total_claims >= 2",
    "high_risk": _any([f"customer_360.current_{d}_risk = 'HIGH'" for d in DIMENSIONS]),
    "valuable": f"customer_360.customer_value >= {ESCALATION_VALUE}",
    "high_churn": "customer_360.churn_risk_label = 'HIGH'",
    "coverage_worry": "coverage_concern",
}
# Whether the data supports an action at all.
SUPPORT = {
    "A": "true",
    "B": "fact.comparable OR fact.lapsed",
    "C": "fact.comparable",
    "D": "fact.high_risk",
    "E": "fact.high_churn AND fact.valuable",
    "F": "fact.open_claim OR fact.several_claims OR fact.lapsed OR fact.coverage_worry",
    "G": "fact.incomplete",
}


def _flags(joined: DataFrame, talked: bool) -> DataFrame:
    """Add the two remaining documents and the facts that scoring looks at."""

    def heard(path: str, kind: str = "string") -> str:
        return f"interaction_intelligence.{path}" if talked else f"cast(NULL AS {kind})"

    fact = ", ".join(f"'{name}', coalesce({condition}, false)" for name, condition in FACTS.items())
    return joined.select(
        "*",
        policy_document().alias("policy_comparison"),
        risk_document().alias("risk_analysis"),
        F.expr(heard("retention_risk")).alias("retention_risk"),
        F.expr(heard("signals.coverage_concern", "boolean")).alias("coverage_concern"),
        F.expr(heard("sentiment.label")).alias("tone"),
        F.expr(heard("intent.label")).alias("intent"),
    ).withColumn("fact", F.expr(f"named_struct({fact})"))


def _points_sql(code: str, position: int, criterion: str) -> str:
    added = [
        f"IF(fact.{fact}, {points}, 0)"
        for fact, action, on, points in ADJUSTMENTS
        if (action, on) == (code, criterion)
    ]
    return f"greatest(1, least(10, {' + '.join([str(BASE[code][position]), *added])}))"


def candidates() -> Column:
    """All seven actions with points, best supported first (ties to the earlier code).

    ``sort_array`` stays in generated code; a sort with a lambda would interpret
    the whole scoring expression.
    """
    rows = []
    for code, title in MENU.items():
        points = {c: _points_sql(code, i, c) for i, c in enumerate(CRITERIA)}
        total = " + ".join(points.values())
        fields = {
            "unsupported": f"NOT ({SUPPORT[code]})",
            "place": f"-({total})",
            "code": f"'{code}'",
            "title": f"'{title}'",
            "composite": total,
            **points,
        }
        inside = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        rows.append(f"named_struct({inside})")
    return F.expr(f"sort_array(array({', '.join(rows)}))")


def score_candidates(context: DataFrame) -> DataFrame:
    """Context with its sorted ``candidates`` array. Unknown customers are left out."""
    return context.filter("known").withColumn("candidates", candidates())


def candidate_rows(scored: DataFrame) -> DataFrame:
    """One row per request and action, ranked."""
    return scored.select(
        "customer_id", "interaction_id", F.posexplode("candidates").alias("position", "candidate")
    ).select(
        "customer_id", "interaction_id", (F.col("position") + 1).alias("rank"),
        "candidate.code", "candidate.title", (~F.col("candidate.unsupported")).alias("eligible"),
        "candidate.composite", *[f"candidate.{c}" for c in CRITERIA],
    )


PRIORITY_SQL = (
    "CASE WHEN fact.major_change OR fact.high_churn OR fact.open_claim THEN 'HIGH' "
    "WHEN (fact.small_change OR NOT fact.comparable) "
    "AND customer_360.churn_risk_label IN ('LOW', 'MINIMAL') THEN 'LOW' ELSE 'MEDIUM' END"
)


def _lines(*parts: str) -> Column:
    """Array of the lines that are not NULL."""
    return F.expr(f"array_compact(array({', '.join(parts)}))")


def facts() -> Column:
    """Statements taken from data only."""
    rises = [
        f"CASE WHEN {d}_direction = 'UP' THEN concat('{d.capitalize()} risk rose from ', prev_{d}_risk, ' to ', "
        f"curr_{d}_risk, ': ', curr_risk_reason) END"
        for d in DIMENSIONS
    ]
    return _lines(
        "concat('Customer for ', string(customer_360.tenure_years), ' years, payment history ', "
        "customer_360.payment_history)",
        "concat(string(customer_360.total_claims), ' claims on file, ', string(customer_360.open_claims), "
        f"' open, total $', {display.whole_sql('customer_360.total_claim_amount')})",
        finding_sql("premium"),
        finding_sql("flood_cov"),
        finding_sql("flood_ded"),
        "CASE WHEN size(exclusions_added) > 0 "
        "THEN concat('Exclusions added: ', array_join(exclusions_added, ', ')) END",
        *rises,
        "CASE WHEN fact.lapsed THEN 'The policy has lapsed' END",
    )


def interpretation() -> Column:
    """Readings of the data, kept apart from the facts."""
    return _lines(
        "concat('Churn risk: ', customer_360.churn_risk_label)",
        "concat('Retention risk: ', retention_risk)",
        "concat('Tone of the last contact: ', tone)",
        "concat('Intent of the last contact: ', intent)",
    )


def talking_points() -> Column:
    """What to say: the next step first, then the relationship, then every line about the risk."""
    others = _lines(
        "concat('Next step: ', best.title)",
        "CASE WHEN customer_360.tenure_years >= 5 AND customer_360.payment_history = 'EXCELLENT' "
        "THEN 'Thank the customer for the long and reliable relationship' END",
    )
    about_risk = F.when(F.col("overall_direction").isNotNull(), communication_points()).otherwise(
        F.expr("cast(array() AS array<string>)")
    )
    return F.concat(others, about_risk)


def risk_flags() -> Column:
    return _lines(
        "CASE WHEN fact.open_claim THEN 'Open claim on file' END",
        "CASE WHEN fact.high_churn THEN 'High churn risk' END",
        "CASE WHEN fact.lapsed THEN 'Policy has lapsed' END",
        "CASE WHEN fact.incomplete THEN 'Property or risk data is incomplete' END",
    )


def alternatives() -> Column:
    """The next supported actions, each with the criterion on which it falls furthest
    behind (ties to the earlier criterion). Supported actions sort first, so the next
    ones are next in the array."""

    def described(position: int) -> str:
        other = f"candidates[{position}]"
        gaps = {c: f"(best.{c} - {other}.{c})" for c in CRITERIA}
        widest = f"greatest({', '.join(gaps.values())})"
        weakest = " ".join(f"WHEN {gap} = {widest} THEN '{name}'" for name, gap in gaps.items())
        reason = (
            f"concat('Scored ', string({other}.composite), ' against ', string(best.composite), "
            f"'; weakest on ', CASE {weakest} END)"
        )
        return (
            f"CASE WHEN NOT {other}.unsupported THEN named_struct('code', {other}.code, "
            f"'title', {other}.title, 'why_not_selected', {reason}) END"
        )

    return _lines(*[described(position + 1) for position in range(ALTERNATIVES)])


def recommend(scored: DataFrame) -> DataFrame:
    """Add ``nba``: the recommendation with its explanation."""
    description = " ".join(f"WHEN '{code}' THEN {texts.quoted(text)}" for code, text in DESCRIPTIONS.items())
    action = (
        f"named_struct('code', best.code, 'title', best.title, 'description', CASE best.code {description} END, "
        f"'priority', {PRIORITY_SQL})"
    )
    why = (
        "concat(best.title, ' scores ', string(best.composite), "
        "' of 40, the most of all actions the data supports')"
    )
    nba = F.struct(
        F.expr(action).alias("recommended_action"),
        F.expr(why).alias("why_this_action"),
        facts().alias("evidence"),
        interpretation().alias("interpretation"),
        alternatives().alias("alternative_actions"),
        talking_points().alias("agent_talking_points"),
        risk_flags().alias("risk_flags"),
    )
    # The first action is always supported: explaining needs nothing.
    return scored.withColumn("best", F.expr("candidates[0]")).withColumn("nba", nba)


def next_best_action(context: DataFrame) -> DataFrame:
    """(customer_id, interaction_id, status, doc) for every request of the context."""
    scored = recommend(context.withColumn("candidates", candidates()))
    known = F.col("known").isNotNull()
    message = F.when(~known, texts.CUSTOMER_NOT_FOUND)
    doc = F.struct(
        F.when(known, "ok").otherwise("not_found").alias("status"),
        "customer_id",
        "interaction_id",
        "customer_name",
        message.alias("message"),
        F.when(
            known,
            F.struct("customer_360", "policy_comparison", "risk_analysis", "interaction_intelligence"),
        ).alias("context"),
        F.when(known, F.col("nba")).alias("nba"),
    )
    return scored.select(
        "customer_id", "interaction_id", F.when(known, "ok").otherwise("not_found").alias("status"),
        doc.alias("doc"),
    )


def build_prompts(context: DataFrame) -> DataFrame:
    """(customer_id, interaction_id, prompt): the context as text for a user's model."""
    menu = "\n".join(f"{code}. {title}" for code, title in MENU.items())
    head = (
        "Recommend one next action for the insurance customer described below.\n"
        "Quote figures from the data for every statement of fact, keep facts and reading apart, "
        "and choose nothing the data does not support.\n\nCustomer:\n"
    )
    tail = (
        f"\n\nActions to choose from:\n{menu}\n\n"
        "Answer with one JSON object and nothing else. Fields: recommended_action (code, title, description, "
        "priority), why_this_action, evidence, alternative_actions (code, title, why_not_selected), "
        "agent_talking_points, risk_flags."
    )
    prompt = F.concat(
        F.lit(head), F.to_json("customer_360"),
        F.lit("\n\nPolicy comparison:\n"), F.to_json("policy_comparison"),
        F.lit("\n\nRisk:\n"), F.to_json("risk_analysis"),
        F.lit("\n\nLast interaction:\n"), F.to_json("interaction_intelligence"),
        F.lit(tail),
    )
    return context.filter("known").select("customer_id", "interaction_id", prompt.alias("prompt"))


def recommend_from_model(responses: DataFrame) -> DataFrame:
    """Recommendations read from model output (primary, retry) instead of the scorer."""
    return with_recommendation(responses, "primary", "retry")
