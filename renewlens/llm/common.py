"""What the corpus operators share: reading tables, hold-outs, written intermediate tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows that Spark hands to Python at a time; whole texts may be long.
BATCH_ROWS = 1_000
#: Shares of rows are cut from hashes in this range: fine enough for a few thousand of 10^12 rows.
HASH_RANGE = 1 << 50
#: Bytes of text that a Python helper works on at a time.
CHUNK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session says how large they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10_000:
        spark.conf.set(key, str(BATCH_ROWS))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores in front as no taken name has (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL ids have none."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def hash_share(key: Column, share: float, seed: str) -> Column:
    """True for about this share of all keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HASH_RANGE)) < F.lit(int(share * HASH_RANGE))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; NULL is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds about CHUNK_BYTES of text or one row; texts stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        start = size = 0
        for i, one in enumerate(texts):
            if size and size + len(one) > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(one)
        yield batch.slice(start), texts[start:]


#: Labelled rows that a classifier is fitted on; beyond, a share of all that is chosen by the hash of the id.
LABELLED_ROWS = 20_000
LABEL_FOLDS, LABEL_HELD_OUT = 3, 1


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", rows: int = LABELLED_ROWS
) -> DataFrame:
    """(doc_id, y, text) of about ``rows`` labelled documents outside the hold-out, stored.

    Ids whose label rows disagree are left out, as are NULL ids, labels and texts. The labels of the
    sample are bounded, so they go to the documents rather than the documents to them.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & (remainder("doc_id", LABEL_FOLDS) != LABEL_HELD_OUT))
    )
    share = min(1.0, rows / max(1, marked.count()))
    once = (
        marked.filter(hash_share(F.col("doc_id"), share, "labels")).groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("doc_id", "y")
    )
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(body.filter("text IS NOT NULL").join(F.broadcast(once), "doc_id"), f"labelled-{label}")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this id are kept from learning; a NULL id is not held out, and never learned from."""
    return F.coalesce(remainder(doc_id, LABEL_FOLDS) == LABEL_HELD_OUT, F.lit(False))
