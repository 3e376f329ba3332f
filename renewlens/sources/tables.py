"""Readers and writers for the seven tables and for JSON documents."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS

Tables = Mapping[str, DataFrame]


POINTERS = "_versions"


def table_folder(spark: SparkSession, root: str, name: str) -> str:
    """Where the present version of a table lies: what the newest pointer names, or the plain folder if it was never replaced."""
    root = root.rstrip("/")
    pointers = spark.read.schema("name string, version long, folder string").parquet
    try:
        newest = pointers(f"{root}/{POINTERS}").filter(F.col("name") == name).agg(F.max(F.struct("version", "folder"))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return f"{root}/{newest['folder'] if newest else name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one table with its declared schema (no inference pass)."""
    return spark.read.schema(SCHEMAS[name]).parquet(table_folder(spark, root, name))


def read_tables(spark: SparkSession, root: str) -> Tables:
    return {name: read_table(spark, root, name) for name in SCHEMAS}


def register_views(tables: Tables) -> None:
    """Make the tables visible to SQL users under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Match columns by name, cast to the contract, fill absent columns with NULL.

    ANSI casts fail on values that do not fit, so a bad date stops the load
    instead of turning into NULL.
    """
    schema = SCHEMAS[name]
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns not in {name}: {sorted(unknown)}")
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Create or replace a table, also from rows of the table itself.

    The new version is written beside the old one; then a pointer to it is added in one small file.
    Readers see the old or the new table and never a gap, those that read already go
    on with what they opened, and a job that is lost leaves the old table. Of two replacements at the same time one
    wins. Old versions stay on disk.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"{name}-{uuid.uuid4().hex}"
    conform(df, name).write.parquet(f"{root}/{folder}")
    present = table_folder(spark, root, name).rsplit("/", 1)[1]
    version = 0
    if present != name:
        pointers = spark.read.schema("name string, version long, folder string").parquet(f"{root}/{POINTERS}")
        version = pointers.filter(F.col("name") == name).agg(F.max("version")).first()[0]
    pointer = spark.createDataFrame([(name, version + 1, folder)], "name string, version long, folder string")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{POINTERS}")


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Append rows by column name to the present version of a table."""
    conform(df, name).write.mode("append").parquet(table_folder(df.sparkSession, root, name))


def literal_rows(
    spark: SparkSession, name: str, rows: Iterable[Sequence], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows given as literals: by position, or by the column names listed.

    Dates and timestamps may be given as text; they are cast strictly.
    """
    columns = list(columns or SCHEMAS[name].names)
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    texts = [tuple(None if v is None else str(v) for v in row) for row in rows]
    return conform(spark.createDataFrame(texts, as_text), name)


def search_source(interaction: DataFrame) -> DataFrame:
    """The text and attribute columns a search index is built from."""
    return interaction.select(
        "interaction_id", "customer_id", "interaction_type", "interaction_timestamp",
        F.col("raw_transcript").alias("text"),
    )


def to_documents(df: DataFrame, doc: str, *keys: str) -> DataFrame:
    """Struct column to JSON text. NULL fields are left out, as documents expect."""
    return df.select(*keys, F.to_json(doc).alias(doc))


def from_documents(df: DataFrame, doc: str, schema: T.StructType) -> DataFrame:
    """JSON text back to a typed struct column."""
    return df.withColumn(doc, F.from_json(doc, schema))
