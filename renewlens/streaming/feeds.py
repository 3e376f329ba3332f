"""Incremental products with Structured Streaming.

Each feed takes a streaming DataFrame and starts a query that writes below
``out``; offsets live in its checkpoint folder. Batch outputs are written to one
folder per batch id and overwritten on a retry, so a lost executor or a restart
repeats a batch without doubling its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import SERVICE_ENGLISH, Lexicon
from ..functions.text import dialogue_turns
from ..operators.customer360 import top_per_key
from ..operators.interactions import score_interactions
from ..operators.risk import assessment_pairs, directions, newest_two
from ..operators.search import build_postings
from ..sources.schemas import SCHEMAS
from ..sources.tables import conform

REFRESH = "1 hour"


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str, **options: str) -> DataFrame:
    """A stream over the parquet files of a folder that match ``glob``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).options(**options).parquet(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the stored ones carry no zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def _batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id}"


def interaction_feed(
    interactions: DataFrame, out: str, checkpoint: str, delay: str = "1 day",
    lexicon: Lexicon = SERVICE_ENGLISH, every: str | None = None,
) -> StreamingQuery:
    """New interactions, each once, with their scores.

    ``interactions`` streams (interaction_id, interaction_timestamp, text) rows,
    one per contact. Repeats within ``delay`` are dropped by the stream; each
    batch is then split into turns and scored by the batch operators.
    """
    unique = (
        event_time(interactions, "interaction_timestamp")
        .withWatermark("interaction_timestamp", delay)
        .dropDuplicatesWithinWatermark(["interaction_id"])
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        turns = dialogue_turns(batch.select("interaction_id", "text"), "text")
        score_interactions(turns, lexicon).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(unique.writeStream.foreachBatch(write), checkpoint, every)


def postings_feed(docs: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Search postings of new documents (doc_id, text), refreshed at a bounded lag.

    A document that comes again replaces its postings for readers of ``latest_postings``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        build_postings(batch.dropDuplicates(["doc_id"]), unique=True).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(docs.writeStream.foreachBatch(write), checkpoint, every)


def latest_postings(spark: SparkSession, out: str) -> DataFrame:
    """The postings of every document from the last batch that brought it."""
    found = spark.read.parquet(out)
    last = found.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return found.join(last, ["doc_id", "batch"]).drop("batch")


def risk_alert_feed(
    assessments: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Risk changes as assessments arrive.

    The state is a table of the newest two assessments per property that each
    batch brought; a batch adds its own and rewrites nothing. A batch is first
    cut to one row per assessment and two per property, so repeats and properties with very many assessments cost little; merged
    with what earlier batches hold of its properties and cut again, the result is
    the same in any order of arrival. A late assessment older than both, or one
    that is delivered again, changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = newest_two(batch.dropDuplicates(["risk_assessment_id"])).drop("rn")
        fresh.write.mode("overwrite").parquet(_batch_folder(f"{out}/state", batch_id))
        schema = T.StructType([*fresh.schema.fields, T.StructField("batch", T.IntegerType())])
        kept = spark.read.schema(schema).parquet(f"{out}/state").filter(F.col("batch") <= batch_id)
        touched = kept.filter(F.col("batch") == batch_id).select("property_id").distinct()
        merged = kept.join(touched, "property_id", "left_semi").drop("batch").dropDuplicates(["risk_assessment_id"])
        (
            assessment_pairs(newest_two(merged))
            .filter("assessments = 2")
            .select("*", *directions(), F.lit(batch_id).alias("seen_in"))
            .write.mode("overwrite")
            .parquet(_batch_folder(f"{out}/changes", batch_id))
        )

    return _start(assessments.writeStream.foreachBatch(write), checkpoint, every)


def latest_risk_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The change of each property after the last batch that touched it."""
    changes = spark.read.parquet(f"{out}/changes").drop("batch")
    return top_per_key(changes, ["property_id"], [F.desc("seen_in")]).drop("rn", "seen_in", "assessments")


def hourly_counts_feed(actions: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Logged actions per hour and status, added up batch by batch.

    Every batch writes its own counts, so there is no state, no hour is held
    back and no late row is lost; ``hourly_counts`` adds them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        hour = F.date_trunc("hour", "action_timestamp").alias("hour")
        counted = batch.groupBy(hour, "status").agg(F.count("*").alias("actions"))
        counted.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(actions.writeStream.foreachBatch(write), checkpoint, every)


def hourly_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("hour", "status").agg(F.sum("actions").alias("actions"))


def action_log_feed(decided: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Decided actions appended to a log table as they arrive, each batch in its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["action_id"])
        conform(rows, "action_log").write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(decided.writeStream.foreachBatch(write), checkpoint, every)


def logged_actions(spark: SparkSession, out: str) -> DataFrame:
    """The streamed log: one row per action id, the first delivery of a repeated one."""
    rows = spark.read.schema(T.StructType([*SCHEMAS["action_log"].fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    return top_per_key(rows, ["action_id"], [F.asc("batch")]).drop("rn", "batch")
