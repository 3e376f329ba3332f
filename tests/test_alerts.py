"""Risk alerts from keyed state against the batch product."""

from __future__ import annotations

import datetime as dt
import random

from renewlens.operators.risk import assessment_pairs, directions, newest_two
from renewlens.streaming import alerts, feeds

SCHEMA = ("risk_assessment_id string, property_id string, assessment_date date, flood_risk string, fire_risk string, "
          "earthquake_risk string, overall_risk_score decimal(3,2), risk_reason string")


class Feed:
    def __init__(self, spark, path):
        self.spark, self.folder, self.out, self.offsets = spark, str(path / "in"), str(path / "out"), str(path / "offsets")
        self.progress = []

    def give(self, *rows):
        """One file, one micro-batch; a new query goes on from the checkpoint."""
        frame = self.spark.createDataFrame(list(rows), SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(self.folder)
        arriving = feeds.stream_files(self.spark, self.folder, frame.schema, "*.parquet", maxFilesPerTrigger="1")
        query = alerts.risk_alert_state_feed(arriving, self.out, self.offsets)
        query.awaitTermination()
        self.progress += [p for p in query.recentProgress if p["numInputRows"]]

    def alerts(self):
        return feeds.latest_risk_alerts(self.spark, self.out)


def one(name, date, level="LOW", prop="P", score=None, reason=None):
    return name, prop, date and dt.date.fromisoformat(date), level, "LOW", None, score, reason


def test_state_goes_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    seen = lambda: [(r.prev_assessment_id, r.curr_assessment_id, r.flood_direction) for r in feed.alerts().collect()]
    feed.give(one("a", "2025-01-01"), one("b", "2025-03-01", "HIGH"), one("x", "2025-03-01", prop=None), one(None, "2025-03-01"))
    assert seen() == [("a", "b", "UP")]
    feed.give(one("old", "2024-01-01", "MEDIUM"), one("b", "2025-03-01", "HIGH"), one("undated", None))
    assert seen() == [("a", "b", "UP")]
    feed.give(one("c", "2025-04-01"), one("c2", "2025-04-01", "MEDIUM"))
    assert seen() == [("c", "c2", "UP")]
    # what changed nothing was not handed on, and no setting of the session was left behind
    assert spark.read.parquet(f"{feed.out}/changes").groupBy("batch").count().count() == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_equals_the_batch_product_and_touches_what_a_batch_brings(spark, tmp_path):
    draw = random.Random(3)
    rows = [
        one(f"r{i:03}", f"2025-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", draw.choice(["LOW", "MEDIUM", "HIGH"]), draw.choice(["hot", f"p{i % 40}"]))
        for i in range(240)
    ]
    late = [one("z", "2026-01-01", "HIGH", "p1")]
    feed = Feed(spark, tmp_path)
    feed.give(*rows[150:], *rows[:10])
    feed.give(*rows[:160])
    feed.give(*late)
    batch = assessment_pairs(newest_two(spark.createDataFrame(rows + late, SCHEMA))).filter("assessments = 2").drop("assessments").select("*", *directions())
    assert sorted(map(str, feed.alerts().select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    last = feed.progress[-1]
    assert last["numInputRows"] == 1 and last["stateOperators"][0]["numRowsUpdated"] <= 2
