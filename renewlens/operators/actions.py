"""Logging decisions, reading the history back, and how recommendations end."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.display import shorten
from ..session import written
from ..sources.tables import append_rows
from .customer360 import top_per_key

# Longest logged texts and the opening words per status.
PAYLOAD_LENGTH = 15000
ACTION_LENGTH = 3500
ACTION_PREFIX = {
    "EXECUTED": "Executed: ",
    "ESCALATED": "Escalated: ",
    "DECLINED": "Declined: ",
    "PENDING": "Pending review: ",
}
STATUSES = ("PENDING", "EXECUTED", "DECLINED", "ESCALATED")
HISTORY_LIMIT = 10


def log_payload(nba: Column, length: int = PAYLOAD_LENGTH) -> Column:
    """The part of a recommendation that is kept with the log row, always whole JSON.

    If the whole does not fit, evidence is dropped from the end until it does,
    and ``evidence_shortened`` says so; all else is kept.
    """
    fixed = [nba["recommended_action"].alias("recommended_action"), nba["why_this_action"].alias("why_this_action")]
    whole = F.to_json(F.struct(*fixed, nba["evidence"].alias("evidence")))
    room = length - F.length(F.to_json(F.struct(*fixed))) - len(',"evidence":[],"evidence_shortened":true')
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(F.to_json(F.array(line)))  # brackets stand for the comma
        return F.struct(used.alias("used"), F.when(used <= room, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(nba["evidence"], start, step, lambda acc: acc["kept"])
    short = F.to_json(F.struct(*fixed, kept.alias("evidence"), F.lit(True).alias("evidence_shortened")))
    return F.when(F.length(whole) <= length, whole).otherwise(short)


def action_text(status: Column, title: Column, override: Column | None = None, length: int | None = None) -> Column:
    """The agent's own words if given, else the title with the status in front; cut only on request."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_PREFIX.items() for x in kv]), status)
    default = F.concat(prefix, title)
    text = default if override is None else F.coalesce(F.nullif(override, F.lit("")), default)
    return text if length is None else shorten(text, length)


def decisions(recommended: DataFrame, status: Column, override: Column | None = None) -> DataFrame:
    """Log rows to be written for recommendations and the status an agent gave them."""
    nba = F.col("nba")
    return recommended.select(
        "customer_id", "interaction_id",
        log_payload(nba).alias("recommended_action"),
        action_text(status, nba["recommended_action"]["title"], override).alias("action_taken"),
        status.alias("status"),
    )


def last_numbers(action_log: DataFrame) -> DataFrame:
    """(second, last): the largest number that a log already holds for a second."""
    parts = F.split("action_id", "-")
    numbered = action_log.filter(F.col("action_id").rlike("^ACT-[0-9]{8}-[0-9]{6}-[0-9]+$")).select(
        F.concat_ws("-", parts[1], parts[2]).alias("second"), parts[3].cast("long").alias("number")
    )
    return numbered.groupBy("second").agg(F.max("number").alias("last"))


def with_action_ids(rows: DataFrame, existing: DataFrame | None = None, writer: int = 0, writers: int = 1) -> DataFrame:
    """Add ``action_id`` = ACT-yyyyMMdd-HHmmss-nnn, numbered within a second.

    Numbers go on after the largest one that the ``existing`` log holds for the
    second, so batches of one second do not repeat ids. Several writers at once each take numbers of their own:
    number ``writer`` of ``writers`` (0 first) uses every ``writers``-th, so ids differ though neither sees what the other
    is about to append. A batch that failed before its append is simply numbered again. A
    batch usually shares one second, so numbering a second in one window would
    run in one task. Rows are numbered within 4,096 hash buckets instead, and
    each bucket starts where the ones before it end. ``rows`` are read twice and
    should be a written table.
    """
    key = F.concat_ws("|", F.col("customer_id").cast("string"), F.col("interaction_id").cast("string"), "action_taken")
    stamped = rows.withColumn("second", F.date_format("action_timestamp", "yyyyMMdd-HHmmss")).withColumn(
        "bucket", F.substring(F.md5(key), 1, 3)
    )
    counts = stamped.groupBy("second", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("second").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("second", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if existing is not None:
        starts = starts.join(last_numbers(existing), "second", "left").select(
            "second", "bucket", (F.col("start") + F.coalesce(F.ceil(F.col("last") / writers), F.lit(0))).alias("start")
        )
    inside = Window.partitionBy("second", "bucket").orderBy("customer_id", "interaction_id", "action_taken")
    numbered = (
        stamped.withColumn("place", F.row_number().over(inside))
        .join(starts, ["second", "bucket"])
        .withColumn("number", ((F.col("start") + F.col("place") - 1) * writers + writer + 1).cast("string"))
    )
    number = F.when(F.length("number") < 3, F.lpad("number", 3, "0")).otherwise(F.col("number"))
    return numbered.withColumn("action_id", F.concat_ws("-", F.lit("ACT"), "second", number)).drop(
        "second", "bucket", "start", "place", "number"
    )


def validate_actions(
    requested: DataFrame, customer: DataFrame, as_of: Column | None = None, existing: DataFrame | None = None,
    writer: int = 0, writers: int = 1,
) -> DataFrame:
    """Requests with ``accepted`` set, and id and timestamp on the accepted ones.

    The time is fixed when this is called, and the result is written to the
    shared folder: rows to log and confirmations come from the same ids. Pass
    the log that will be appended to as ``existing``; where several jobs append
    at once, each names its ``writer`` number out of ``writers``.
    """
    if not 0 <= writer < writers:
        raise ValueError("writer must be from 0 to writers - 1")
    if as_of is None:
        as_of = F.lit(datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0).isoformat()).cast("timestamp_ntz")
    known = customer.select("customer_id").distinct().withColumn("accepted", F.lit(True))
    checked = written(
        requested.join(known, "customer_id", "left")
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))
        .withColumn("action_timestamp", F.when(F.col("accepted"), as_of)),
        "actions-asked",
    )
    accepted = with_action_ids(checked.filter("accepted"), existing, writer, writers)
    return written(accepted.unionByName(checked.filter("NOT accepted"), allowMissingColumns=True), "actions-checked")


def log_rows(validated: DataFrame) -> DataFrame:
    """The rows an append writes."""
    return validated.filter("accepted").select(
        "action_id", "customer_id", "interaction_id", "recommended_action", "action_taken",
        "action_timestamp", "status",
    )


def log_results(validated: DataFrame) -> DataFrame:
    """One confirmation or error per request."""
    return validated.select(
        F.when(F.col("accepted"), "ok").otherwise("error").alias("status"),
        "action_id",
        "customer_id",
        F.when(F.col("accepted"), F.col("status")).alias("action_status"),
        F.when(F.col("accepted"), texts.ACTION_LOGGED)
        .otherwise(texts.CUSTOMER_NOT_FOUND)
        .alias("message"),
    )


def append_actions(validated: DataFrame, root: str) -> None:
    append_rows(log_rows(validated), root, "action_log")


def action_history(action_log: DataFrame, customer: DataFrame) -> DataFrame:
    """Log rows with the customer's name. Order belongs to the reader."""
    names = customer.select("customer_id", F.col("name").alias("customer_name"))
    return action_log.join(names, "customer_id").select(
        "action_id", "customer_id", "customer_name", "interaction_id", "action_taken", "status",
        "action_timestamp", "recommended_action",
    )


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("action_timestamp"), F.desc("action_id"))


def recent_actions(action_log: DataFrame, customer: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """Newest ``n`` actions of every customer; cut before the names are joined."""
    newest = [F.desc("action_timestamp"), F.desc("action_id")]
    top = top_per_key(action_log, ["customer_id"], newest, n, rank="rank")
    names = customer.select("customer_id", F.col("name").alias("customer_name"))
    return top.join(names, "customer_id").select(
        "customer_id", "rank", "action_id", "customer_name", "action_taken", "status", "action_timestamp"
    )


def _code() -> Column:
    return F.get_json_object("recommended_action", "$.recommended_action.code").alias("code")


def _outcomes() -> tuple[list[Column], list[Column]]:
    """Counts per status, and their shares of all actions."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    rates = [
        (F.floor(F.col(s.lower()) * 10000 / F.col("actions") + 0.5) / 10000).alias(f"{s.lower()}_rate")
        for s in STATUSES
    ]
    return counts, rates


def action_outcomes(action_log: DataFrame) -> DataFrame:
    """How often each recommended action ends in each status, with rates."""
    counts, rates = _outcomes()
    return action_log.groupBy(_code()).agg(F.count("*").alias("actions"), *counts).select("*", *rates)


def outcome_cube(action_log: DataFrame, interaction: DataFrame) -> DataFrame:
    """Outcomes by recommended action and channel, with totals over either and over both.

    The channel is the type of the interaction that an action followed; an
    action without one, or whose interaction is not known, has the channel
    NULL. ``level`` tells such a NULL from a total: 0 is a single cell, 1 sums over channels,
    2 over actions, 3 over everything. Actions are expanded to four groupings only within
    tasks, where they are counted; cells are few, and so is what is shuffled after the join.
    """
    counts, rates = _outcomes()
    channel = interaction.select("interaction_id", F.col("interaction_type").alias("channel"))
    named = action_log.select("interaction_id", "status", _code()).join(channel, "interaction_id", "left")
    cells = named.cube("code", "channel").agg(F.grouping_id().alias("level"), F.count("*").alias("actions"), *counts)
    return cells.select("code", "channel", F.col("level").cast("long").alias("level"), "actions", *[s.lower() for s in STATUSES], *rates)
