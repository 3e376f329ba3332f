"""From raw documents to a training mixture: five stages, each written as Parquet and read again.

1. ``language``: documents that language identification rejects go.
2. ``near_duplicates``: one document of every SimHash group stays.
3. ``decontamination``: documents that hold a benchmark window go.
4. ``personal_data``: every span is replaced by its kind in brackets; ``n_chars`` follows.
5. ``mixture``: documents are drawn at rates that rake source, language and topic to their targets.

Every stage works on all that the one before kept. No stage drops a document for anything but its own decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm import decontaminate, language, mixture, pii, simhash
from renewlens.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what is rejected: no letter, or less likely than any text seen in calibration."""
    return language.identify(docs, language.train(docs)).filter("NOT rejected").select(*COLUMNS)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    return simhash.one_per_group(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of ten words of any benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced."""
    cleaned = pii.redact(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with ``mix_rate`` and ``mix_copies``."""
    return mixture.sample(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_per_group),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
]

#: Language identification is fitted, and fingerprints rest on XXH64: SQL expresses neither. tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
