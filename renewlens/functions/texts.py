"""Messages and sentence parts that documents must carry verbatim."""

from __future__ import annotations


def quoted(text: str | None) -> str:
    """A text as a SQL literal."""
    if text is None:
        return "NULL"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


CUSTOMER_NOT_FOUND = "Customer not found"
NO_RENEWAL = "No renewal proposal found for this customer"
NO_RISK_CHANGE = "Only one risk assessment on file — no change to compare"
NO_RISK_DATA = "No risk assessment on file"
NO_POLICY_IMPACT = "No renewal proposal — policy impact not available"
INTERACTION_NOT_FOUND = "Interaction not found"
EMPTY_TRANSCRIPT = "Transcript is empty — cannot analyze"
NO_INTERACTION = "No interaction provided"
ACTION_LOGGED = "Action logged successfully"

# Opening words of the key findings, per compared field.
FINDING_SUBJECTS = {
    "premium": "Premium",
    "deductible": "General deductible",
    "building": "Building coverage",
    "contents": "Contents coverage",
    "flood_cov": "Flood coverage",
    "flood_ded": "Flood deductible",
}
EXCLUSIONS_CHANGED = "Exclusions changed"

# Communication points in their order: (risk dimension that must be UP, or None for always, text).
COMMUNICATION_POINTS = (
    (None, "The risk change is based on external factors, not the customer's behavior or claims history"),
    ("flood", "FEMA or local authority reclassified the area — the customer's property itself has not changed"),
    ("earthquake", "Seismic models were updated by USGS — this affects all properties in the zone"),
    ("fire", "Wildfire risk models were updated based on recent fire-season data"),
    (None, "The customer may be able to reduce premiums by taking risk-prevention measures"),
    ("flood", "Flood mitigation options: sump pump, backflow valve, elevation certificate, flood barriers"),
    ("fire", "Fire mitigation options: defensible space, fire-resistant roofing, ember-resistant vents"),
)
