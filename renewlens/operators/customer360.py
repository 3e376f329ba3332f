"""One row per customer: who they are, what they own, hold, claimed and said."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import churn_label
from ..sources.tables import Tables


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of every key.

    Each map task keeps only its own first ``n`` before the shuffle (a partial
    window group limit), so a key holding most of the rows sends ``n`` rows per
    task and never lands whole in one reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
HOT_PARTS = 64


def _repeated_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, n) of keys with more than ``rows`` rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows)


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """(key, parts) of keys with more than ``rows`` rows, with the most parts a key is dealt over. Counting
    combines map-side, so it does not depend on the skew."""
    return _repeated_keys(df, key, rows).select(key, F.lit(HOT_PARTS).alias("parts"))


def spread_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, parts): the hot keys, each with a part per ``rows`` of its rows, ``HOT_PARTS`` at most."""
    parts = F.least(F.ceil(F.col("n") / max(rows, 1)), F.lit(HOT_PARTS)).cast("int")
    return _repeated_keys(df, key, rows).select(key, parts.alias("parts"))


def join_repeated(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, rows: int | None = HOT_ROWS
) -> DataFrame:
    """Left join to a side that repeats some keys very often.

    An outer join cannot split its optional side, so the rows of hot keys are
    dealt over parts by ``spread_by`` and the left row is repeated per part. Hot
    keys are those of ``right`` itself, so each of them has matches, and parts
    without one are dropped again. All other rows, NULL keys included, stay in
    one part. A key has one part per ``rows`` of its rows, ``HOT_PARTS`` at most, so left rows are
    repeated less often than they match. One narrow count decides whether there are any; ``rows`` None
    trusts that there are none and starts no job.
    """
    if rows is None:
        return left.join(right, key, "left")
    hot = spread_keys(right, key, rows)
    if hot.isEmpty():
        return left.join(right, key, "left")
    dealt = (
        right.join(hot, key, "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("parts")), F.lit(0)).cast("int"))
        .withColumn("matched", F.lit(True))
        .drop("parts")
    )
    return (
        left.join(hot, key, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(dealt, [key, "part"], "left")
        .filter("matched IS NOT NULL OR parts = 1")
        .drop("part", "parts", "matched")
    )


def split_repeated(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose keys occur once, rows whose keys occur again); NULL is a key like any other.

    One narrow count decides; without repeats the frame itself comes back, with None.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias(f"again_{k}") for k in keys])
    if again.isEmpty():
        return df, None
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in keys])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def claim_summary(claim: DataFrame) -> DataFrame:
    return claim.groupBy("customer_id").agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col("claim_status") == "OPEN").alias("open_claims"),
        F.sum("claim_amount").alias("total_claim_amount"),
        F.max("claim_date").alias("last_claim_date"),
    )


def home_keys(risk_history: DataFrame) -> list[str]:
    """What an assessment has in common with its home; tables that are co-located by customer name that too."""
    return [c for c in ("customer_id", "property_id") if c in risk_history.columns]


def latest_risk(risk_history: DataFrame) -> DataFrame:
    """Newest assessment per property; equal dates go to the larger id."""
    newest = [F.desc("assessment_date"), F.desc("risk_assessment_id")]
    return top_per_key(risk_history, home_keys(risk_history), newest).drop("rn")


def latest_interaction(interaction: DataFrame) -> DataFrame:
    """Newest interaction per customer; equal times go to the larger id."""
    newest = [F.desc_nulls_last("interaction_timestamp"), F.desc("interaction_id")]
    return top_per_key(interaction, ["customer_id"], newest).drop("rn")


def renewal_keys(policy_version: DataFrame) -> DataFrame:
    return policy_version.filter("policy_version = 'RENEWAL'").select("customer_id").distinct()


def renewal_flag(tables: Tables) -> DataFrame:
    proposed = renewal_keys(tables["policy_version"]).withColumn("proposed", F.lit(True))
    return tables["customer"].join(proposed, "customer_id", "left").select(
        "customer_id", F.col("proposed").isNotNull().alias("has_renewal_proposal")
    )


def churn_bands(customer: DataFrame) -> DataFrame:
    return customer.select(
        "customer_id", "churn_risk_score", churn_label("churn_risk_score").alias("churn_risk_label")
    )


def chosen_homes(tables: Tables) -> DataFrame:
    """One home per customer: a home with a changed risk first, then the smallest id."""
    changed = tables["risk_history"].groupBy("property_id").agg((F.count("*") > 1).alias("changed"))
    homes = tables["property"].join(changed, "property_id", "left")
    order = [F.desc(F.coalesce("changed", F.lit(False))), F.asc("property_id")]
    return top_per_key(homes, ["customer_id"], order).drop("rn", "changed")


def chosen_policies(policy_version: DataFrame) -> DataFrame:
    """One current policy per customer: one with proposed terms first, then the smallest id."""
    has = {n: F.bool_or(F.col("policy_version") == n) for n in ("CURRENT", "RENEWAL")}
    held = policy_version.groupBy("customer_id", "policy_id").agg(has["CURRENT"].alias("cur"), has["RENEWAL"].alias("ren"))
    return top_per_key(held.filter("cur"), ["customer_id"], [F.desc("ren"), F.asc("policy_id")]).select("customer_id", "policy_id")


def customer_360(tables: Tables, holdings: str = "all", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The 41-column customer product.

    Everything that is unique per customer is joined first; homes and current
    policies, which may legitimately repeat a customer, come last so that a
    repeated customer is not carried through the other joins. All joins but the
    risk one share the customer key and therefore one partitioning.

    ``holdings`` says what happens to several homes or current policies: "all"
    keeps every combination and spreads customers with more than ``hot_rows``
    of them (None: nobody has that many, and no job is started), "first" keeps
    the home and the policy that ``chosen_homes`` and ``chosen_policies`` pick.
    """
    customer = tables["customer"]
    claims = claim_summary(tables["claim"])
    proposed = renewal_keys(tables["policy_version"]).withColumn("proposed", F.lit(True))
    said = latest_interaction(tables["interaction"]).select(
        "customer_id",
        F.col("interaction_id").alias("last_interaction_id"),
        F.col("interaction_type").alias("last_interaction_type"),
        F.col("interaction_timestamp").alias("last_interaction_timestamp"),
        F.col("raw_transcript").alias("last_interaction_transcript"),
        F.col("agent_note").alias("last_interaction_note"),
    )
    home = home_keys(tables["risk_history"])
    risk = latest_risk(tables["risk_history"]).select(
        *home,
        F.col("flood_risk").alias("current_flood_risk"),
        F.col("fire_risk").alias("current_fire_risk"),
        F.col("earthquake_risk").alias("current_earthquake_risk"),
        F.col("overall_risk_score").alias("current_risk_score"),
        F.col("risk_reason").alias("current_risk_reason"),
        F.col("assessment_date").alias("risk_assessment_date"),
    )
    homes = tables["property"]
    current = (
        tables["policy_version"]
        .filter("policy_version = 'CURRENT'")
        .drop("policy_version", "policy_type")
    )
    if holdings == "first":
        homes, hot_rows = chosen_homes(tables), None
        current = current.join(chosen_policies(tables["policy_version"]), ["customer_id", "policy_id"])
    facts = (
        customer.join(claims, "customer_id", "left")
        .join(proposed, "customer_id", "left")
        .join(said, "customer_id", "left")
    )
    housed = join_repeated(facts, homes.join(risk, home, "left"), "customer_id", "property_id", hot_rows)
    return (
        join_repeated(housed, current, "customer_id", "policy_id", hot_rows)
        .select(
            "customer_id", "name", "age", "tenure_years", "customer_value", "payment_history",
            "churn_risk_score", churn_label("churn_risk_score").alias("churn_risk_label"),
            "property_id", "property_type", "location", "building_age", "construction_type",
            "policy_id", "policy_status", "effective_date", "expiry_date", "annual_premium", "deductible",
            "building_coverage", "contents_coverage", "flood_coverage", "flood_deductible", "exclusions",
            "renewal_date",
            F.col("proposed").isNotNull().alias("has_renewal_proposal"),
            F.coalesce("total_claims", F.lit(0)).alias("total_claims"),
            F.coalesce("open_claims", F.lit(0)).alias("open_claims"),
            F.coalesce("total_claim_amount", F.lit(0)).alias("total_claim_amount"),
            "last_claim_date",
            "current_flood_risk", "current_fire_risk", "current_earthquake_risk", "current_risk_score",
            "current_risk_reason", "risk_assessment_date",
            "last_interaction_id", "last_interaction_type", "last_interaction_timestamp",
            "last_interaction_transcript", "last_interaction_note",
        )
    )


def customer_list(tables: Tables) -> DataFrame:
    """The picker: five columns in customer order, from the customers and their proposals alone."""
    proposed = renewal_keys(tables["policy_version"]).withColumn("proposed", F.lit(True))
    return tables["customer"].join(proposed, "customer_id", "left").select(
        "customer_id", "name", churn_label("churn_risk_score").alias("churn_risk_label"),
        F.col("proposed").isNotNull().alias("has_renewal_proposal"), "tenure_years",
    ).orderBy("customer_id")
