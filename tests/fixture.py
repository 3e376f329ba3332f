"""A small portfolio of twelve customers.

Fixed values: keys, amounts, dates, codes and scores, which the expected results
follow from. Names, reasons and transcripts are our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from renewlens.sources.tables import literal_rows

CUSTOMERS = [
    # customer_id, name, age, tenure_years, customer_value, payment_history, churn_risk_score
    ("C001", "Ada North", 42, 6.5, 18500, "EXCELLENT", 0.35),
    ("C002", "Ben East", 55, 3.0, 9200, "GOOD", 0.40),
    ("C003", "Cleo South", 61, 1.2, 7800, "FAIR", 0.78),
    ("C004", "Dan West", 37, 5.0, 12300, "EXCELLENT", 0.08),
    ("C005", "Eva Hill", 49, 6.8, 15400, "GOOD", 0.30),
    ("C006", "Fay Lake", 58, 9.2, 22100, "EXCELLENT", 0.15),
    ("C007", "Gus Moor", 44, 4.5, 11000, "FAIR", 0.55),
    ("C008", "Hana Reed", 29, 0.8, 5200, "GOOD", 0.20),
    ("C009", "Ian Vale", 52, 7.0, 31000, "EXCELLENT", 0.10),
    ("C010", "Joy Ford", 35, 2.5, 8900, "GOOD", 0.45),
    ("C011", "Kit Dale", 63, 10.0, 19500, "POOR", 0.85),
    ("C012", "Lea Shore", 31, 1.5, 6700, "GOOD", 0.18),
]
PROPERTIES = [
    ("P001", "C001", "SINGLE_FAMILY", "Riverton", 22, "WOOD_FRAME"),
    ("P002", "C002", "SINGLE_FAMILY", "Bayside", 15, "BRICK"),
    ("P003", "C003", "TOWNHOME", "Hillcrest", 8, "WOOD_FRAME"),
    ("P004", "C004", "CONDO", "Highline", 5, "CONCRETE"),
    ("P005", "C005", "SINGLE_FAMILY", "Oakridge", 30, "WOOD_FRAME"),
    ("P006", "C006", "SINGLE_FAMILY", "Portview", 45, "BRICK"),
    ("P007", "C007", "SINGLE_FAMILY", "Gulfside", 28, "WOOD_FRAME"),
    ("P008", "C008", "CONDO", "Midtown", 3, "CONCRETE"),
    ("P009", "C009", "SINGLE_FAMILY", "Parkland", 18, "MIXED"),
    ("P010", "C010", "TOWNHOME", "Desert Springs", 12, "BRICK"),
    ("P011", "C011", "SINGLE_FAMILY", "Plainview", 55, "WOOD_FRAME"),
    ("P012", "C012", "CONDO", "Harborview", 2, "CONCRETE"),
]
POLICIES = [
    # policy, customer, version, type, status, effective, expiry, premium, deductible, building, contents,
    # flood coverage, flood deductible, exclusions, renewal date
    ("POL001", "C001", "CURRENT", "HOME", "ACTIVE", "2025-04-01", "2026-03-31", 8500, 1500, 250000, 75000, 50000, 2500,
     "Earthquake, intentional damage", "2026-03-31"),
    ("POL001", "C001", "RENEWAL", "HOME", "PROPOSED", "2026-04-01", "2027-03-31", 10030, 1500, 250000, 75000, 35000, 5000,
     "Earthquake, intentional damage, sewer backup", "2027-03-31"),
    ("POL002", "C002", "CURRENT", "HOME", "ACTIVE", "2025-01-15", "2026-01-14", 11200, 2000, 300000, 40000, 50000, 3000,
     "Earthquake", "2026-01-14"),
    ("POL003", "C003", "CURRENT", "HOME", "ACTIVE", "2025-11-01", "2026-10-31", 6800, 2500, 220000, 30000, 0, 0,
     "Flood, earthquake", "2026-10-31"),
    ("POL003", "C003", "RENEWAL", "HOME", "PROPOSED", "2026-11-01", "2027-10-31", 7500, 2500, 220000, 30000, 0, 0,
     "Flood, earthquake", "2027-10-31"),
    ("POL004", "C004", "CURRENT", "HOME", "ACTIVE", "2025-06-20", "2026-06-19", 5400, 1000, 180000, 50000, 50000, 1500,
     "None", "2026-06-19"),
    ("POL005", "C005", "CURRENT", "HOME", "ACTIVE", "2025-02-01", "2026-01-31", 9800, 2000, 400000, 60000, 0, 0,
     "Flood", "2026-01-31"),
    ("POL005", "C005", "RENEWAL", "HOME", "PROPOSED", "2026-02-01", "2027-01-31", 12500, 2500, 480000, 70000, 0, 0,
     "Flood", "2027-01-31"),
    ("POL006", "C006", "CURRENT", "HOME", "ACTIVE", "2025-05-01", "2026-04-30", 7200, 1500, 280000, 45000, 25000, 2000,
     "Intentional damage", "2026-04-30"),
    ("POL006", "C006", "RENEWAL", "HOME", "PROPOSED", "2026-05-01", "2027-04-30", 8900, 2000, 280000, 45000, 25000, 3000,
     "Intentional damage", "2027-04-30"),
    ("POL007", "C007", "CURRENT", "HOME", "ACTIVE", "2025-03-01", "2026-02-28", 13500, 3000, 270000, 35000, 40000, 4000,
     "Earthquake, mold", "2026-02-28"),
    ("POL008", "C008", "CURRENT", "HOME", "ACTIVE", "2025-12-01", "2026-11-30", 4200, 1000, 160000, 40000, 30000, 1500,
     "Earthquake", "2026-11-30"),
    ("POL008", "C008", "RENEWAL", "HOME", "PROPOSED", "2026-12-01", "2027-11-30", 4400, 1000, 160000, 40000, 30000, 1500,
     "Earthquake", "2027-11-30"),
    ("POL009", "C009", "CURRENT", "HOME", "ACTIVE", "2025-07-01", "2026-06-30", 18500, 5000, 950000, 150000, 100000, 10000,
     "None", "2026-06-30"),
    ("POL010", "C010", "CURRENT", "HOME", "ACTIVE", "2025-09-01", "2026-08-31", 6100, 1500, 200000, 35000, 20000, 2000,
     "Earthquake, sewer backup", "2026-08-31"),
    ("POL011", "C011", "CURRENT", "HOME", "LAPSED", "2024-08-01", "2025-07-31", 8900, 2000, 240000, 40000, 30000, 3000,
     "Earthquake", "2025-07-31"),
    ("POL012", "C012", "CURRENT", "HOME", "ACTIVE", "2025-10-15", "2026-10-14", 3800, 750, 120000, 60000, 15000, 1000,
     "Earthquake", "2026-10-14"),
]
RISKS = [
    ("RA001", "P001", "2024-03-15", "MEDIUM", "LOW", "LOW", 0.42, "Standard profile"),
    ("RA002", "P001", "2026-01-20", "HIGH", "LOW", "LOW", 0.78, "Flood map revised"),
    ("RA003", "P002", "2025-06-10", "HIGH", "LOW", "LOW", 0.82, "Active flood zone"),
    ("RA004", "P003", "2025-11-01", "LOW", "MEDIUM", "LOW", 0.30, "Some wildfire exposure"),
    ("RA005", "P004", "2025-05-15", "LOW", "LOW", "LOW", 0.12, "Low-risk zone"),
    ("RA006", "P005", "2025-01-10", "LOW", "HIGH", "MEDIUM", 0.74, "Wildfire corridor"),
    ("RA007", "P006", "2024-09-01", "LOW", "LOW", "MEDIUM", 0.35, "Near a fault"),
    ("RA008", "P006", "2026-02-15", "LOW", "LOW", "HIGH", 0.62, "Fault model revised"),
    ("RA009", "P007", "2025-08-20", "HIGH", "LOW", "LOW", 0.70, "Hurricane coast"),
    ("RA010", "P008", "2025-12-01", "LOW", "LOW", "LOW", 0.10, "New construction"),
    ("RA011", "P009", "2025-07-01", "LOW", "MEDIUM", "HIGH", 0.55, "Near a fault"),
    ("RA012", "P010", "2025-09-15", "LOW", "MEDIUM", "LOW", 0.28, "Dry brush"),
    ("RA013", "P011", "2025-04-01", "MEDIUM", "LOW", "LOW", 0.38, "Near a river"),
    ("RA014", "P012", "2025-10-01", "LOW", "LOW", "MEDIUM", 0.22, "Seismic region"),
]
CLAIMS = [
    ("CLM001", "C001", "POL001", "THEFT", "CLOSED", 1800, "2022-11-05"),
    ("CLM002", "C002", "POL002", "FLOOD", "OPEN", 38000, "2026-09-28"),
    ("CLM003", "C005", "POL005", "FIRE", "CLOSED", 52000, "2025-10-12"),
    ("CLM004", "C004", "POL004", "THEFT", "CLOSED", 1200, "2023-04-02"),
    ("CLM005", "C007", "POL007", "FLOOD", "CLOSED", 15000, "2024-06-18"),
    ("CLM006", "C007", "POL007", "FLOOD", "CLOSED", 22000, "2025-04-30"),
    ("CLM007", "C007", "POL007", "LIABILITY", "CLOSED", 8500, "2025-09-10"),
    ("CLM008", "C011", "POL011", "FLOOD", "DENIED", 12000, "2025-05-20"),
]
INTERACTIONS = [
    ("INT001", "C001", "CALL", "2026-10-03 09:14:00",
     "Agent: Good morning, how can I help?\n\nCustomer: My renewal letter shows a higher premium. Why did the price go up?\n"
     "Is my coverage the same? I may look at other options.\n\nAgent: Let me explain what changed.", None),
    ("INT002", "C002", "CALL", "2026-10-02 16:40:00",
     "Agent: I see an open claim.\nCustomer: Yes, what is the status of my claim? The adjuster never called. I am anxious.",
     "Anxious about the claim"),
    ("INT003", "C003", "CHAT", "2026-09-30 11:05:00",
     "Customer: I have quotes from other companies and may switch. The premium is too high.\nAgent: Let me see our options.",
     "Shopping around"),
    ("INT004", "C004", "EMAIL", "2026-10-01 08:22:00",
     "Subject: Last invoice\n\nThe autopay charge was higher than usual. What is the breakdown? Thanks", None),
    ("INT005", "C005", "CALL", "2026-09-25 14:50:00",
     "Customer: Is the rebuilt house fully covered? My dwelling limit is too low.\nAgent: We will review it.", None),
    ("INT006", "C006", "CALL", "2026-03-10 10:30:00",
     "Agent: Hello.\nCustomer: My renewal premium went up and I do not understand it.", None),
    ("INT007", "C007", "CALL", "2026-02-05 15:20:00",
     "Agent: Hello.\nCustomer: Will I have trouble with the renewal after these tough years?", None),
    ("INT008", "C011", "EMAIL", "2026-09-15 09:00:00",
     "Subject: Coverage again\n\nMy policy lapsed because I missed some payments. Can you reinstate it?", None),
]

ROWS = {
    "customer": CUSTOMERS,
    "property": PROPERTIES,
    "policy_version": POLICIES,
    "risk_history": RISKS,
    "claim": CLAIMS,
    "interaction": INTERACTIONS,
    "action_log": [],
}


def portfolio(spark: SparkSession, **extra: list) -> dict[str, DataFrame]:
    """The tables, with rows added to any of them."""
    return {
        name: literal_rows(spark, name, [*rows, *extra.get(name, [])]).cache() for name, rows in ROWS.items()
    }
