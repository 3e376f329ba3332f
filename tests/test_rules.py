"""Edge rows for every rule that is easy to get wrong."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from fixture import portfolio
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from renewlens.functions import rules
from renewlens.operators import decide, policy, quality, risk
from renewlens.operators.customer360 import (
    customer_360,
    hot_keys,
    join_repeated,
    latest_interaction,
    latest_risk,
)
from renewlens.sources.tables import append_rows, conform, literal_rows, read_table, replace_table, table_folder


def graded(spark, pairs, field):
    df = spark.createDataFrame(pairs, "old decimal(12,2), new decimal(12,2)")
    return [r[0] for r in df.select(rules.severity("old", "new", field)).collect()]


def test_thresholds_are_strict_and_unrounded(spark):
    pairs = [(D(100), D(115)), (D(100), D("115.01")), (D(100), D(105)), (D(100), D("105.01")), (D(100), D(80)),
             (D(1000000), D("1150000.10"))]
    assert graded(spark, pairs, "premium") == ["MODERATE", "MAJOR", "MINOR", "MODERATE", "MAJOR", "MAJOR"]
    assert graded(spark, [(D(100), D(120)), (D(100), D(110))], "building") == ["MODERATE", "MINOR"]
    assert graded(spark, [(D(100), D(150)), (D(100), D(120))], "flood_ded") == ["MODERATE", "MINOR"]


def test_zero_and_missing_sides(spark):
    pairs = [(D(0), D(10)), (None, D(10)), (D(10), None), (None, None), (D(0), D(0)), (D(0), None), (D(10), D(0))]
    assert graded(spark, pairs, "premium") == ["MINOR", "UNCHANGED", "UNCHANGED", "UNCHANGED", "UNCHANGED", "UNCHANGED", "MAJOR"]
    assert graded(spark, pairs, "flood_cov") == ["MINOR", "UNCHANGED", "UNCHANGED", "UNCHANGED", "UNCHANGED", "UNCHANGED", "MAJOR"]


def test_directions_rank_missing_lowest(spark):
    df = spark.createDataFrame(
        [("LOW", "HIGH"), ("HIGH", "LOW"), ("LOW", "LOW"), (None, "LOW"), (None, None), ("LOW", "odd"), (None, "HIGH")],
        "a string, b string",
    )
    assert [r[0] for r in df.select(rules.risk_direction("a", "b")).collect()] == [
        "UP", "DOWN", "UNCHANGED", "DOWN", "DOWN", "DOWN", "UP"
    ]


def test_labels(spark):
    scores = [D("0.70"), D("0.69"), D("0.40"), D("0.20"), D("0.19"), None]
    df = spark.createDataFrame([(s,) for s in scores], "s decimal(3,2)")
    assert [r[0] for r in df.select(rules.churn_label("s")).collect()] == [
        "HIGH", "MODERATE", "MODERATE", "LOW", "MINIMAL", "MINIMAL"
    ]
    tones = spark.createDataFrame([(x,) for x in (0.31, 0.3, 0.0, -0.3, -0.6, None)], "s double")
    assert [r[0] for r in tones.select(rules.sentiment_label("s")).collect()] == [
        "Positive", "Neutral", "Mildly Concerned", "Concerned", "Very Negative", "Very Negative"
    ]
    mixed = spark.createDataFrame(
        [("high", 1.0), ("moderate", 1.0), ("none", -0.31), ("low", 1.0), ("none", -0.1), ("none", 0.0), (None, None),
         ("low", None)], "c string, s double"
    )
    assert [r[0] for r in mixed.select(rules.retention_risk("c", "s")).collect()] == [
        "HIGH", "ELEVATED", "ELEVATED", "LOW", "LOW", "MINIMAL", "MINIMAL", "LOW"
    ]


def version(policy_id, customer, kind, premium, flood=100, exclusions="A", status="ACTIVE"):
    return (policy_id, customer, kind, "HOME", status, "2025-01-01", "2025-12-31", premium, 10, 10, 10, flood, 10,
            exclusions, "2025-12-31")


def test_comparison_needs_both_versions_of_one_policy(spark):
    rows = [
        version("X1", "C009", "RENEWAL", 10),
        version("X2", "C010", "CURRENT", 10), version("X3", "C010", "RENEWAL", 20),
        version("X4", "C012", "HISTORICAL", 5),
        version("X5", "C004", "CURRENT", 10, exclusions="a, b"), version("X5", "C004", "RENEWAL", 10, exclusions="B,A"),
    ]
    tables = portfolio(spark, policy_version=rows)
    compared = {r.policy_id: r for r in policy.policy_comparison(tables).collect()}
    assert set(compared) == {"POL001", "POL003", "POL005", "POL006", "POL008", "X5"}
    # The flag is raised by any renewal row, comparable or not.
    flags = {r.customer_id: r.has_renewal_proposal for r in customer_360(tables).collect()}
    assert flags["C009"] and flags["C010"] and not flags["C012"]
    # Raw text differs, the items do not.
    row = compared["X5"]
    assert row.exclusions_changed and row.exclusions_added == [] and row.exclusions_removed == []


def test_sentence_without_percent_disappears(spark):
    rows = [version("X1", "C012", "CURRENT", 10, flood=0), version("X1", "C012", "RENEWAL", 11, flood=50)]
    tables = portfolio(spark, policy_version=rows)
    docs = policy.compare_policy(tables, spark.createDataFrame([("C012",)], "customer_id string")).first().doc
    assert docs.flood_coverage.severity == "MINOR" and docs.flood_coverage.change_pct is None
    assert docs.key_findings == ["Premium increased by 10.0% ($1/year)"]


def test_repeated_homes_and_policies_repeat_the_customer(spark):
    tables = portfolio(
        spark,
        property=[("P901", "C001", "CONDO", "Elsewhere", 1, "BRICK")],
        policy_version=[version("X1", "C001", "CURRENT", 10)],
    )
    rows = [r for r in customer_360(tables).collect() if r.customer_id == "C001"]
    assert len(rows) == 4 and {r.total_claims for r in rows} == {1}
    report = {r.test_id: r.result for r in quality.customer_checks(customer_360(tables), 12).collect()}
    assert report["customer_360_completeness"] == "FAIL"


def test_very_many_holdings_are_spread_without_changing_rows(spark):
    homes = [(f"P9{i:02d}", "C001", "CONDO", "Elsewhere", 1, "BRICK") for i in range(30)]
    tables = dict(portfolio(spark, property=homes, policy_version=[version("X1", "C001", "CURRENT", 10)]))
    assert [tuple(r) for r in hot_keys(tables["property"], "customer_id", rows=20).collect()] == [("C001", 64)]
    plain, spread = (sorted(map(str, customer_360(tables, hot_rows=n).collect())) for n in (None, 1))
    assert plain == spread and sum("customer_id='C001'" in r for r in plain) == 62
    first = customer_360(tables, holdings="first").filter("customer_id = 'C001'").collect()
    assert [(r.property_id, r.policy_id) for r in first] == [("P001", "POL001")]


def test_spreading_keeps_keys_without_a_match_and_null_keys(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, n int")
    right = spark.createDataFrame([("a", i) for i in range(50)] + [("c", 100), (None, 200)], "k string, v int")
    plain, spread = (sorted(map(str, join_repeated(left, right, "k", "v", n).collect())) for n in (None, 3))
    assert plain == spread and len(plain) == 53


def test_hot_customers_without_a_comparable_policy_keep_their_status(spark):
    renewals = [version(f"X{i}", "C012", "RENEWAL", 10) for i in range(9)]
    homes = [(f"P9{i:02d}", "C012", "CONDO", "Elsewhere", 1, "BRICK") for i in range(9)]
    tables = portfolio(spark, policy_version=renewals, property=homes)
    ids = spark.createDataFrame([("C012",), ("C001",), (None,), ("C999",)], "customer_id string")
    for fn in (policy.compare_policy, risk.analyze_risk):
        plain, spread = (sorted(map(str, fn(tables, ids, n).collect())) for n in (None, 1))
        assert plain == spread and len(plain) == 4
    assert {r.customer_id: r.status for r in policy.compare_policy(tables, ids, 1).collect()}["C012"] == "no_renewal"


def test_one_document_per_changed_home_whatever_the_policies(spark):
    tables = portfolio(
        spark,
        property=[("P901", "C001", "CONDO", "Elsewhere", 1, "BRICK")],
        risk_history=[("RA900", "P901", "2025-01-01", "LOW", "LOW", "LOW", 0.1, "one"), ("RA901", "P901", "2026-01-01", "HIGH", "LOW", "LOW", 0.5, "two")],
        policy_version=[version("X1", "C001", "CURRENT", 10), version("X1", "C001", "RENEWAL", 20)],
    )
    docs = risk.analyze_risk(tables, spark.createDataFrame([("C001",)], "customer_id string")).collect()
    assert sorted(d.doc.property_id for d in docs) == ["P001", "P901"]
    assert {d.doc.policy_impact.policy_id for d in docs} == {"POL001"}


def test_a_decision_speaks_of_one_home_and_one_policy(spark):
    tables = portfolio(
        spark,
        property=[("P000", "C001", "CONDO", "Elsewhere", 1, "BRICK")],
        risk_history=[("RA900", "P000", "2025-01-01", "LOW", "LOW", "LOW", 0.1, "one")],
        policy_version=[version("A1", "C001", "CURRENT", 10)],
    )
    asked = spark.createDataFrame([("C001", None)], "customer_id string, interaction_id string")
    row = decide.nba_context(tables, asked).first()
    assert (row.customer_360.property_id, row.risk_analysis.property_id, row.customer_360.location) == ("P001", "P001", row.risk_analysis.location)
    assert row.customer_360.policy_id == row.policy_comparison.policy_id == row.risk_analysis.policy_impact.policy_id == "POL001"
    assert row.fact.risk_up and row.fact.high_risk


def test_newest_two_of_many_with_tied_dates(spark):
    rows = [
        ("RA100", "P004", "2025-05-15", "MEDIUM", "LOW", "LOW", 0.50, "same day"),
        ("RA101", "P004", "2020-01-01", "HIGH", "HIGH", "HIGH", 0.99, "old"),
    ]
    tables = portfolio(spark, risk_history=rows)
    row = [r for r in risk.risk_change(tables).collect() if r.property_id == "P004"][0]
    assert (row.prev_assessment_id, row.curr_assessment_id, row.flood_direction) == ("RA005", "RA100", "UP")
    newest = {r.property_id: r.risk_assessment_id for r in latest_risk(tables["risk_history"]).collect()}
    assert newest["P004"] == "RA100"


def test_changed_home_hides_the_single_assessment_of_another(spark):
    tables = portfolio(
        spark,
        property=[("P901", "C001", "CONDO", "Elsewhere", 1, "BRICK")],
        risk_history=[("RA900", "P901", "2025-01-01", "LOW", "LOW", "LOW", 0.1, "one")],
    )
    docs = risk.analyze_risk(tables, spark.createDataFrame([("C001",)], "customer_id string")).collect()
    assert [d.status for d in docs] == ["ok"]


def test_no_assessment_and_no_renewal(spark):
    tables = dict(portfolio(spark, customer=[("C900", "New", 30, 0.1, 100, "GOOD", 0.1)]))
    ids = spark.createDataFrame([("C900",), ("C006",)], "customer_id string")
    docs = {r.customer_id: r for r in risk.analyze_risk(tables, ids).collect()}
    assert docs["C900"].status == "no_risk_data"
    tables["policy_version"] = tables["policy_version"].filter("policy_version = 'CURRENT'")
    impact = risk.analyze_risk(tables, ids).filter("customer_id = 'C006'").first().doc.policy_impact
    assert impact.message == "No renewal proposal — policy impact not available" and impact.overall_severity is None


def test_unknown_rating_drops_its_line(spark):
    rows = [("RA900", "P012", "2026-01-01", None, "LOW", "MEDIUM", 0.11, "gap")]
    tables = portfolio(spark, risk_history=rows)
    doc = risk.analyze_risk(tables, spark.createDataFrame([("C012",)], "customer_id string")).first().doc
    assert doc.changes.flood.direction == "DOWN"
    assert doc.causal_chain == ["Overall risk score changed from 0.22 to 0.11 (-50.0%)"]


def test_latest_interaction_breaks_ties(spark):
    rows = [("INT900", "C001", "CALL", "2026-10-03 09:14:00", "again", None)]
    tables = portfolio(spark, interaction=rows)
    assert {r.customer_id: r.interaction_id for r in latest_interaction(tables["interaction"]).collect()}["C001"] == "INT900"


def test_quality_finds_what_is_broken(spark):
    tables = portfolio(
        spark,
        claim=[("CLM001", "C777", "POL001", "METEOR", "OPEN", 1, "2024-01-01")],
        risk_history=[("RA900", "P777", "2024-01-01", "LOW", "LOW", "LOW", 0.1, "x" * 501)],
    )
    failed = {r.test_id: r.details for r in quality.quality_report(tables).collect() if r.result == "FAIL"}
    assert failed["foreign_key:claim.customer_id"] == "orphans=1"
    assert failed["foreign_key:risk_history.property_id"] == "orphans=1"
    assert failed["primary_key:claim"] == "bad_keys=1"
    assert failed["domain:claim.claim_type"] == "outside=1"
    assert "risk_reason=1" in failed["length:risk_history"]


def test_replace_and_append(spark, tables, tmp_path):
    root = str(tmp_path)
    replace_table(tables["claim"], root, "claim")
    replace_table(tables["claim"], root, "claim")
    extra = literal_rows(spark, "claim", [("2024-02-03", "CLM900", "C001")], ["claim_date", "claim_id", "customer_id"])
    append_rows(extra, root, "claim")
    back = read_table(spark, root, "claim")
    assert back.count() == 9
    row = back.filter("claim_id = 'CLM900'").first()
    assert (str(row.claim_date), row.claim_amount) == ("2024-02-03", None)
    with pytest.raises(ValueError):
        conform(tables["claim"].withColumn("other", F.lit(1)), "claim")


def test_bad_date_stops_the_load(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        literal_rows(spark, "claim", [("CLM1", "C1", None, None, None, None, "2024-13-01")]).collect()


amounts = st.one_of(st.none(), st.decimals(min_value=0, max_value=999999, places=2))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(amounts, amounts), min_size=1, max_size=40))
def test_severity_matches_plain_arithmetic(spark, pairs):
    def plain(old, new):
        if not old and not new:
            return "UNCHANGED"
        if old is None or new is None:
            return "UNCHANGED"
        if old and abs(new - old) * 100 > 20 * old:
            return "MAJOR"
        if old and abs(new - old) * 100 > 10 * old:
            return "MODERATE"
        return "MINOR" if old != new else "UNCHANGED"

    assert graded(spark, pairs, "flood_cov") == [plain(a, b) for a, b in pairs]


def test_a_failing_replacement_leaves_the_table(spark, tables, tmp_path):
    root = str(tmp_path)
    replace_table(tables["claim"], root, "claim")
    opened = read_table(spark, root, "claim")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        replace_table(tables["claim"].withColumn("claim_date", F.concat(F.lit("2024-13-"), F.col("claim_id"))), root, "claim")
    whole = tables["claim"].count()
    assert read_table(spark, root, "claim").count() == whole
    # from rows of the table itself; who had opened the old one reads on
    replace_table(read_table(spark, root, "claim").limit(2), root, "claim")
    append_rows(tables["claim"].limit(1), root, "claim")
    assert read_table(spark, root, "claim").count() == 3 and opened.count() == whole
    assert len({table_folder(spark, root, n) for n in ("claim", "customer")}) == 2
