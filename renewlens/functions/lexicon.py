"""Word lists that drive the default text operators.

A lexicon is a parameter: ``sentiment`` maps words to weights, ``intent`` maps
labels to words, ``signal`` maps signal names to words. Labels are matched on
whole words, so one word may serve several entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Intent labels in tie-break order; the last one is the default.
INTENTS = (
    "renewal_inquiry",
    "claim_status",
    "billing_question",
    "cancellation_request",
    "coverage_concern",
    "complaint",
    "general_inquiry",
)
DEFAULT_INTENT = INTENTS[-1]
SIGNALS = ("churn", "urgency", "pricing", "coverage", "complaint")

# Above this many entries a lexicon is joined without a broadcast hint, so that
# its measured size decides between a broadcast and a shuffle join.
BROADCAST_ENTRIES = 50_000
# A word that no text holds; it stands for the turn itself.
ANCHOR = ""


@dataclass(frozen=True)
class Lexicon:
    sentiment: dict[str, float]
    intent: dict[str, tuple[str, ...]]
    signal: dict[str, tuple[str, ...]]
    # hits on customer turns that reach each level, strongest first
    churn_levels: tuple[tuple[str, int], ...] = (("high", 3), ("moderate", 2), ("low", 1))
    urgency_levels: tuple[tuple[str, int], ...] = (("critical", 4), ("high", 3), ("medium", 1))
    # hits on customer turns from which a yes/no concern is raised
    concern_hits: dict[str, int] = field(
        default_factory=lambda: {"pricing": 1, "coverage": 1, "complaint": 1}
    )

    def entries(self) -> list[tuple[str, str, str, float]]:
        rows = [(w, "sentiment", "sentiment", float(v)) for w, v in self.sentiment.items()]
        rows += [(w, "intent", label, 1.0) for label, ws in self.intent.items() for w in ws]
        rows += [(w, "signal", name, 1.0) for name, ws in self.signal.items() for w in ws]
        return rows

    def columns(self) -> list[str]:
        """One number column per entry: tone weight and hits, intents, signals."""
        return [
            "tone_sum", "tone_hits",
            *[f"intent_{label}" for label in self.intent],
            *[f"signal_{name}" for name in SIGNALS],
        ]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per word with its numbers, and the row of zeros of the empty word."""
        columns = self.columns()
        numbers: dict[str, dict[str, float]] = {ANCHOR: {}}
        for word, kind, entry, weight in self.entries():
            row = numbers.setdefault(word, {})
            if kind == "sentiment":
                row["tone_sum"] = row.get("tone_sum", 0.0) + weight
                row["tone_hits"] = row.get("tone_hits", 0.0) + 1
            else:
                row[f"{kind}_{entry}"] = row.get(f"{kind}_{entry}", 0.0) + 1
        rows = [(word, *[row.get(c, 0.0) for c in columns]) for word, row in numbers.items()]
        schema = "word string, " + ", ".join(f"{c} double" for c in columns)
        df = spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_ENTRIES else df


# Default for English service conversations.
SERVICE_ENGLISH = Lexicon(
    sentiment={
        "thank": 1.0, "thanks": 1.0, "great": 1.0, "happy": 1.0, "good": 0.5, "better": 0.5, "fine": 0.5,
        "appreciate": 1.0, "understand": 0.25, "help": 0.25, "best": 0.5, "important": 0.25,
        "confused": -0.5, "worried": -0.75, "anxious": -1.0, "trouble": -0.5, "tough": -0.5, "rough": -0.5,
        "sorry": -0.25, "delay": -0.5, "angry": -1.0, "unacceptable": -1.0, "torn": -0.5, "lapsed": -0.5,
        "missed": -0.5, "concern": -0.25, "issues": -0.25,
    },
    intent={
        "renewal_inquiry": ("renew", "renewal", "renewing", "reinstate", "premium"),
        "claim_status": ("claim", "claims", "adjuster", "repairs", "status"),
        "billing_question": ("invoice", "autopay", "charge", "billing", "payment", "breakdown"),
        "cancellation_request": ("cancel", "cancellation", "leave", "terminate"),
        "coverage_concern": ("covered", "coverage", "limit", "dwelling", "exclusion"),
        "complaint": ("complaint", "unacceptable", "complain", "terrible"),
    },
    signal={
        "churn": ("cancel", "quotes", "competitor", "competitors", "companies", "options", "leave", "switch"),
        "urgency": ("urgent", "immediately", "asap", "anxious", "status", "waiting", "today"),
        "pricing": ("price", "premium", "cost", "expensive", "paying", "charge", "increased"),
        "coverage": ("coverage", "covered", "limit", "exclusion", "dwelling"),
        "complaint": ("complaint", "unacceptable", "complain", "terrible", "angry"),
    },
)
