"""Expected results on the twelve-customer portfolio."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from renewlens.operators import decide, interactions, policy, quality, risk
from renewlens.operators.customer360 import customer_360, customer_list
from renewlens.functions.text import dialogue_turns
from renewlens.plans.views import register_products
from renewlens.sources.schemas import SCHEMAS
from renewlens.sources.tables import register_views

U, MI, MO, MA = "UNCHANGED", "MINOR", "MODERATE", "MAJOR"
COMPARISONS = {
    "C001": [(1530, "18.0", MA), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), (-15000, "-30.0", MA), (2500, "100.0", MA), True, MA],
    "C003": [(700, "10.3", MO), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), (0, None, U), (0, None, U), False, MO],
    "C005": [(2700, "27.6", MA), (500, "25.0", MO), (80000, "20.0", MO), (10000, "16.7", MO), (0, None, U), (0, None, U), False, MA],
    "C006": [(1700, "23.6", MA), (500, "33.3", MO), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), (1000, "50.0", MO), False, MA],
    "C008": [(200, "4.8", MI), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), (0, "0.0", U), False, MI],
}


def test_policy_comparison(tables):
    rows = {r.customer_id: r for r in policy.policy_comparison(tables).collect()}
    assert set(rows) == set(COMPARISONS)
    for key, expected in COMPARISONS.items():
        row = rows[key]
        for stem, (change, pct, severity) in zip(policy.MEASURES, expected):
            assert row[f"{stem}_change"] == change
            assert row[f"{stem}_change_pct"] == (None if pct is None else Decimal(pct))
            assert row[f"{stem}_severity"] == severity
        assert (row.exclusions_changed, row.overall_severity) == (expected[6], expected[7])
    assert rows["C001"].exclusions_added == ["sewer backup"]
    assert rows["C001"].exclusions_removed == []


def test_comparison_columns(tables):
    columns = policy.policy_comparison(tables).columns
    assert len(columns) == 43 and columns[-2:] == ["exclusions_added", "exclusions_removed"]
    assert columns[40] == "overall_severity"


def test_risk_change(tables):
    df = risk.risk_change(tables)
    assert len(df.columns) == 25
    rows = {r.customer_id: r for r in df.collect()}
    assert set(rows) == {"C001", "C006"}
    a, f = rows["C001"], rows["C006"]
    assert (a.prev_flood_risk, a.curr_flood_risk, a.flood_direction) == ("MEDIUM", "HIGH", "UP")
    assert (a.fire_direction, a.earthquake_direction) == (U, U)
    assert (a.risk_score_change, a.risk_score_change_pct) == (Decimal("0.36"), Decimal("85.7"))
    assert (f.earthquake_direction, f.risk_score_change_pct, f.overall_direction) == ("UP", Decimal("77.1"), "INCREASED")


C360 = {
    "C001": ("LOW", True, 1, 0, 1800, "HIGH", "LOW", "LOW", "0.78", "INT001"),
    "C002": ("MODERATE", False, 1, 1, 38000, "HIGH", "LOW", "LOW", "0.82", "INT002"),
    "C003": ("HIGH", True, 0, 0, 0, "LOW", "MEDIUM", "LOW", "0.30", "INT003"),
    "C004": ("MINIMAL", False, 1, 0, 1200, "LOW", "LOW", "LOW", "0.12", "INT004"),
    "C005": ("LOW", True, 1, 0, 52000, "LOW", "HIGH", "MEDIUM", "0.74", "INT005"),
    "C006": ("MINIMAL", True, 0, 0, 0, "LOW", "LOW", "HIGH", "0.62", "INT006"),
    "C007": ("MODERATE", False, 3, 0, 45500, "HIGH", "LOW", "LOW", "0.70", "INT007"),
    "C008": ("LOW", True, 0, 0, 0, "LOW", "LOW", "LOW", "0.10", None),
    "C009": ("MINIMAL", False, 0, 0, 0, "LOW", "MEDIUM", "HIGH", "0.55", None),
    "C010": ("MODERATE", False, 0, 0, 0, "LOW", "MEDIUM", "LOW", "0.28", None),
    "C011": ("HIGH", False, 1, 0, 12000, "MEDIUM", "LOW", "LOW", "0.38", "INT008"),
    "C012": ("MINIMAL", False, 0, 0, 0, "LOW", "LOW", "MEDIUM", "0.22", None),
}


def test_customer_360(tables):
    df = customer_360(tables)
    assert len(df.columns) == 41
    found = {
        r.customer_id: (
            r.churn_risk_label, r.has_renewal_proposal, r.total_claims, r.open_claims, r.total_claim_amount,
            r.current_flood_risk, r.current_fire_risk, r.current_earthquake_risk, str(r.current_risk_score),
            r.last_interaction_id,
        )
        for r in df.collect()
    }
    assert found == C360
    assert [r.customer_id for r in customer_list(tables).collect()] == sorted(C360)


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(c,) for c in ("C001", "C002", "C003", "C004", "C006", "C999")], "customer_id string")


def test_policy_documents(tables, requests):
    docs = {r.customer_id: r for r in policy.compare_policy(tables, requests).collect()}
    assert {k: r.status for k, r in docs.items()} == {
        "C001": "ok", "C002": "no_renewal", "C003": "ok", "C004": "no_renewal", "C006": "ok", "C999": "not_found"
    }
    assert docs["C001"].doc.key_findings == [
        "Premium increased by 18.0% ($1,530/year)",
        "Flood coverage decreased by 30.0%",
        "Flood deductible increased by 100.0%",
        "Exclusions changed",
    ]
    assert docs["C001"].doc.flood_coverage.renewal == 35000
    assert docs["C004"].doc.customer_name == "Dan West" and docs["C004"].doc.premium is None
    assert docs["C999"].doc.message == "Customer not found"


def test_documents_leave_out_absent_fields(tables, requests):
    import json

    docs = policy.compare_policy(tables, requests).select("customer_id", F.to_json("doc").alias("j")).collect()
    unknown = json.loads({r.customer_id: r.j for r in docs}["C999"])
    assert unknown == {"status": "not_found", "customer_id": "C999", "message": "Customer not found"}


def test_risk_documents(tables, requests):
    docs = {r.customer_id: r for r in risk.analyze_risk(tables, requests).collect()}
    assert {k: r.status for k, r in docs.items()} == {
        "C001": "ok", "C002": "no_risk_change", "C003": "no_risk_change", "C004": "no_risk_change", "C006": "ok",
        "C999": "not_found",
    }
    hero, quake = docs["C001"].doc, docs["C006"].doc
    assert hero.causal_chain == [
        "Flood risk changed from MEDIUM to HIGH",
        "Overall risk score changed from 0.42 to 0.78 (+85.7%)",
    ]
    assert len(hero.communication_points) == 4
    # An earthquake rise is explained but has no mitigation line.
    assert len(quake.causal_chain) == 2 and len(quake.communication_points) == 3
    assert hero.policy_impact.overall_severity == MA and hero.policy_impact.message is None
    assert docs["C004"].doc.current_risk.overall_risk_score == Decimal("0.12")
    assert docs["C004"].doc.changes is None


def test_renewal_report(tables):
    rows = policy.renewal_report(policy.policy_comparison(tables)).filter("customer_id = 'C001'").orderBy("position")
    shown = [(r.field, r.current, r.renewal, r.change, r.percent, r.severity) for r in rows.collect()]
    assert shown[0] == ("Annual Premium", "$8,500", "$10,030", "+$1,530", "+18.0%", MA)
    assert shown[1] == ("General Deductible", "$1,500", "$1,500", "—", "—", U)
    assert shown[4] == ("Flood Coverage", "$50,000", "$35,000", "$-15,000", "-30.0%", MA)


def test_best_actions_without_conversation(tables, spark):
    requests = spark.createDataFrame([("C001",), ("C002",), ("C003",)], "customer_id string").withColumn(
        "interaction_id", F.lit(None).cast("string")
    )
    scored = decide.score_candidates(decide.nba_context(tables, requests))
    rows = {r.customer_id: r for r in decide.recommend(scored).collect()}

    def top(key, n):
        return [(c.code, c.composite) for c in rows[key].candidates if not c.unsupported][:n]

    assert top("C001", 3) == [("C", 31), ("D", 27), ("B", 23)]
    assert top("C002", 2) == [("D", 26), ("F", 26)]
    assert top("C003", 2) == [("C", 29), ("E", 29)]
    nba = rows["C001"].nba
    assert (nba.recommended_action.code, nba.recommended_action.priority) == ("C", "HIGH")
    assert [a.code for a in nba.alternative_actions] == ["D", "B"]
    assert "Exclusions added: sewer backup" in nba.evidence
    assert "Flood risk rose from MEDIUM to HIGH: Flood map revised" in nba.evidence
    assert nba.interpretation == ["Churn risk: LOW"]
    assert nba.agent_talking_points[0].startswith("Next step: ") and len(nba.agent_talking_points) >= 5


def test_decision_documents_with_conversation(tables, spark):
    turns = dialogue_turns(tables["interaction"])
    docs = interactions.analyze_interactions(
        tables["interaction"].select("interaction_id"), tables["interaction"].drop("raw_transcript"), turns,
        tables["customer"],
    )
    requests = decide.default_requests(customer_360(tables)).unionByName(
        spark.createDataFrame([("C999", None)], "customer_id string, interaction_id string")
    )
    context = decide.nba_context(tables, requests, docs)
    found = {r.customer_id: r for r in decide.next_best_action(context).collect()}
    assert len(found) == 13
    assert found["C999"].status == "not_found" and found["C999"].doc.nba is None
    assert found["C008"].doc.context.interaction_intelligence.status == "no_interaction"
    assert found["C001"].doc.context.interaction_intelligence.intent.label == "renewal_inquiry"
    assert found["C001"].doc.context.policy_comparison.overall_severity == MA
    for row in found.values():
        if row.status == "ok":
            assert row.doc.nba.recommended_action.code in "ABCDEFG"
            assert len(row.doc.nba.alternative_actions) <= 2
    prompts = decide.build_prompts(context).collect()
    assert len(prompts) == 12 and all("Actions to choose from" in p.prompt for p in prompts)


def test_quality_report_passes(tables):
    expected = {"customer": 12, "property": 12, "policy_version": 17, "risk_history": 14, "claim": 8, "interaction": 8,
                "action_log": 0}
    report = quality.quality_report(tables, expected, expected_comparisons=5, expected_changes=2).collect()
    assert {r.test_id: r.details for r in report if r.result != "PASS"} == {}
    shown = {r.test_id: r.details for r in report}
    assert shown["policy_comparison_range"] == "renewals=5, without_percent=0, lowest=4.8, highest=27.6"


def test_expected_values(tables, spark):
    schema = "customer_id string, premium_change_pct decimal(5,1), flood_cov_change_pct decimal(5,1), exclusions_changed boolean"
    good = spark.createDataFrame([("C001", Decimal("18.0"), Decimal("-30.0"), True)], schema)
    bad = spark.createDataFrame([("C001", Decimal("18.1"), Decimal("-30.0"), True)], schema)
    comparison = policy.policy_comparison(tables)
    result = [
        quality.expected_values(comparison, "one_customer", e, ["customer_id"]).first().result for e in (good, bad)
    ]
    assert result == ["PASS", "FAIL"]
    wanted = spark.createDataFrame([("C001", "MEDIUM", "HIGH", "UP")],
                                   "customer_id string, prev_flood_risk string, curr_flood_risk string, flood_direction string")
    assert quality.expected_values(risk.risk_change(tables), "risk", wanted, ["customer_id"]).first().result == "PASS"


def test_products_as_views(spark, tables):
    register_views(tables)
    register_products(tables)
    row = spark.sql(
        "SELECT v.name, p.premium_change_pct, r.flood_direction FROM v_customer_360 v "
        "JOIN v_policy_comparison p USING (customer_id) JOIN v_risk_change r USING (customer_id) "
        "JOIN customer c USING (customer_id) WHERE v.customer_id = 'C001'"
    ).first()
    assert tuple(row) == ("Ada North", Decimal("18.0"), "UP")
    assert spark.sql("SELECT * FROM v_action_history").count() == 0


def test_schemas_hold(tables):
    for name, df in tables.items():
        assert df.columns == SCHEMAS[name].names
