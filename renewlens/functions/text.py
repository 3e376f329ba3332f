"""Words, sentences and dialogue turns as row-local column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE = "[^.!?\\n]+[.!?]*"
SPEAKERS = ("Agent", "Customer")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, of the whole text, in order."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences; a line break also ends one."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(F.trim(text)) == 0)


def dialogue_turns(interaction: DataFrame, text: str = "raw_transcript") -> DataFrame:
    """Transcripts split into turns: (interaction_id, turn_no, speaker, subject, text).

    A turn starts at a line opening with a speaker label and runs to the next
    one. Text without a label was written by the customer; a leading mail
    subject is kept apart. Everything happens inside the row.
    """
    labels = "|".join(SPEAKERS)
    pieces = F.split(F.col(text), f"\\n(?=(?:{labels}):)")
    piece = F.col("piece")
    label = F.regexp_extract(piece, f"^\\s*({labels}):", 1)
    body = F.regexp_replace(piece, f"^\\s*(?:{labels}):", "")
    subject = F.regexp_extract(body, "^\\s*Subject:[ \\t]*([^\\n]*)", 1)
    return interaction.select(
        "interaction_id", F.posexplode(pieces).alias("turn_no", "piece")
    ).select(
        "interaction_id",
        F.col("turn_no").cast("long").alias("turn_no"),
        F.when(label == "", "Customer").otherwise(label).alias("speaker"),
        F.nullif(subject, F.lit("")).alias("subject"),
        F.trim(F.regexp_replace(body, "^\\s*Subject:[^\\n]*\\n?", "")).alias("text"),
    )
