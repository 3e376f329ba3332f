"""A text index that is refreshed by a stream and searched while it grows.

Every micro-batch writes a segment: the anchored postings of its documents, and then
one row per document that says which version came with which batch. The last
version of a document wins. ``merge_segments`` folds all segments so far into one;
document frequencies, the number of documents and their mean length are those of the
live documents at the time of a search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from ..operators.search import BROADCAST_ROWS, LIMIT, asked_vocabulary, build_postings, is_small, query_words
from ..operators.topk import bounded_rank
from ..session import written
from .feeds import _batch_folder, _start

KEY = ["doc_id", "version", "batch"]


def segment_feed(docs: DataFrame, out: str, checkpoint: str, version: str | None = None, every: str | None = None) -> StreamingQuery:
    """Index a stream of documents (doc_id, text) below ``out``.

    A document that comes again replaces itself; with a ``version`` column (a whole number) the
    largest version wins in any order of arrival, and equal versions and those without go by arrival. A
    NULL text takes a document out. Rows without an id cannot be replaced and are left out. Segments hold the
    postings of one micro-batch under its number and are overwritten on a retry.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(0) if version is None else F.coalesce(version, F.lit(0))
        given = batch.filter("doc_id IS NOT NULL").select(
            "doc_id", number.cast("long").alias("version"), F.xxhash64("text").alias("mark"), "text"
        )
        newest = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc("mark"))
        # the texts are dealt by document once, for the window and for the postings; the second job needs none of them
        last = given.repartition("doc_id").withColumn("n", F.row_number().over(newest)).filter("n = 1")
        _save(build_postings(last, anchored=True, keep=("version",), unique=True), _batch_folder(f"{out}/postings", batch_id))
        # written last: a batch without its documents is not read
        _save(last.select("doc_id", "version"), _batch_folder(f"{out}/documents", batch_id))

    return _start(docs.writeStream.foreachBatch(write), checkpoint, every)


def _save(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def _head(spark: SparkSession, out: str) -> int:
    """The last batch that is folded into a merged segment, -1 if there is none."""
    try:
        heads = spark.read.schema("done boolean, upto int").parquet(f"{out}/heads")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    return heads.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _parts(spark: SparkSession, out: str, what: str, head: int) -> DataFrame:
    """``documents`` or ``postings`` of the merged segment and of all batches behind it."""
    fresh = spark.read.parquet(f"{out}/{what}").filter(F.col("batch") > head)
    return fresh if head < 0 else spark.read.parquet(f"{out}/merged/upto={head}/{what}").unionByName(fresh)


def _state(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, int]:
    """(documents with ``last``, their postings, the last finished batch)."""
    head = _head(spark, out)
    documents = _parts(spark, out, "documents", head)
    upto = documents.agg(F.max("batch")).first()[0]
    upto = head if upto is None else max(head, upto)
    newest = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc("batch"))
    ranked = documents.filter(F.col("batch") <= upto).withColumn("last", F.row_number().over(newest) == 1)
    postings = _parts(spark, out, "postings", head).filter(F.col("batch") <= upto)
    # what was replaced is little beside all postings: it is taken out, they are not gathered by document
    # (the version of a document that was taken out has no postings)
    replaced = ranked.filter("NOT last").select(*KEY)
    return ranked, postings.join(F.broadcast(replaced) if is_small(replaced) else replaced, KEY, "left_anti"), upto


def live_postings(spark: SparkSession, out: str) -> DataFrame:
    """Anchored postings (doc_id, word, length, tf) of the last version of every document."""
    return _state(spark, out)[1].select("doc_id", "word", "length", "tf")


def merge_segments(spark: SparkSession, out: str) -> int:
    """Fold all finished segments into one; returns the last batch in it.

    Replaced versions are left behind. The merged segment is read only after its head was written, so searches and
    the feed go on meanwhile and a lost job leaves what was there; merging again without new batches does nothing. Earlier segments stay on disk.
    """
    head = _head(spark, out)
    documents, postings, upto = _state(spark, out)
    if upto > head:
        folder = f"{out}/merged/upto={upto}"
        _save(postings, f"{folder}/postings")
        # documents that were taken out are kept as such: an older version may still arrive
        _save(documents.filter("last").drop("last"), f"{folder}/documents")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{out}/heads/upto={upto}")
    return upto


def search_segments(spark: SparkSession, out: str, queries: DataFrame, k: int = LIMIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Best ``k`` live documents per query: the rows that ``text_search`` gives over the last version of all documents."""
    wanted = written(query_words(queries), "query-words")
    postings = live_postings(spark, out).join(asked_vocabulary(wanted, broadcast_rows), "word", "left_semi")
    return bounded_rank(written(postings, "postings"), wanted, k, broadcast_rows=broadcast_rows)
