"""Ranked text search, vector search and substring search over a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counting import word_counts
from ..functions.text import words
from ..session import written
from ..sources.tables import search_source
from .customer360 import split_repeated, top_per_key

K1, B = 1.2, 0.75
LIMIT = 5
# Largest request side that is sent whole to every task.
BROADCAST_ROWS = 200_000
BROADCAST_VECTORS = 4_096
# Pairs of a document and a query that one task scores, and the tasks there are at least.
TASK_PAIRS, MIN_TASKS = 1_000_000, 8


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` may be sent whole to every task, after counting at most ``rows`` + 1
    rows. Larger frames are left to a shuffle join, whose skewed partitions adaptive
    execution splits."""
    return df.limit(rows + 1).count() <= rows


def round4(value):
    return F.floor(value * 10000 + 0.5) / 10000


# Stands in every document's postings and carries its length; no text yields it as a word.
ANCHOR = ""


def build_postings(
    docs: DataFrame, vocabulary: DataFrame | None = None, anchored: bool = False, keep: tuple[str, ...] = (), unique: bool = False
) -> DataFrame:
    """(doc_id, word, length, tf) of ``docs``, one row per document, all postings of a document together.

    Words are counted in the row of their text, so neither texts nor words are
    shuffled and no task holds the words of many texts; those of a document that comes in several rows are
    added up. With a ``vocabulary`` (one ``word`` column) all other words are dropped. ``anchored``
    adds one row per document, so that lengths can be read from the postings. Columns to
    ``keep`` belong to the document. ``unique`` says that no document comes again.
    """
    key = ["doc_id", *keep]
    texts = docs.select(*key, "text")
    single, repeated = (texts, None) if unique else split_repeated(texts, key)
    counted = _counted(single, key, vocabulary, anchored)
    if repeated is not None:
        added = _counted(repeated, key, vocabulary, anchored).groupBy(*key, "word")
        counted = counted.unionByName(added.agg(F.max("length").alias("length"), F.sum("tf").alias("tf")))
    return counted.select(*key, "word", "length", "tf")


def _counted(texts: DataFrame, key: list[str], vocabulary: DataFrame | None, anchored: bool) -> DataFrame:
    """(``key``, word, length, tf) of every row of ``texts``."""
    found = texts.filter(F.col("text").isNotNull()).select(*key, words(F.col("text")).alias("found"))
    found = found.select(*key, F.size("found").cast("long").alias("length"), "found")
    if anchored:
        found = found.withColumn("found", F.concat(F.array(F.lit(ANCHOR)), "found"))
    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in key]
    counted = found.mapInArrow(word_counts([*key, "length"]), ", ".join([*kinds, "length long, word string, tf long"]))
    return counted if vocabulary is None else counted.join(vocabulary, "word", "left_semi")


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word, qtf) over the whole query texts."""
    return (
        queries.select("query_id", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("qtf"))
    )


def rank_postings(
    postings: DataFrame, wanted: DataFrame, k: int = LIMIT, k1: float = K1, b: float = B,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Top ``k`` documents per query: (query_id, rank, doc_id, text_match), from anchored postings.

    Postings are dealt by document, so the scores of a document meet in one
    task whatever its words are; each task then keeps ``k`` rows per query
    before the last shuffle. No word gathers its documents in one place, and there are as many
    tasks as keep the (document, query) pairs of each below ``TASK_PAIRS``. More query words than are broadcast would send
    all those pairs through a shuffle: then only documents that can reach the first ``k`` are scored.
    """
    if not is_small(wanted, broadcast_rows):
        from .topk import bounded_rank

        return bounded_rank(postings, wanted, k, k1=k1, b=b, broadcast_rows=broadcast_rows)
    n, mean_length = postings.filter(F.col("word") == ANCHOR).agg(F.count("*"), F.avg("length")).first()
    tasks = n * wanted.select("query_id").distinct().count() // TASK_PAIRS + 1
    frequency = postings.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # The weights have no more rows than the query words that were counted.
    weights = wanted.join(frequency, "word").select("query_id", "word", (F.col("qtf") * idf).alias("weight"))
    tf, length = F.col("tf"), F.col("length")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean_length or 1.0)))
    scores = (
        postings.select("doc_id", "word", gain.alias("gain"))
        .repartition(max(tasks, MIN_TASKS), "doc_id")
        .join(F.broadcast(weights), "word")
        .groupBy("doc_id", "query_id")
        .agg(round4(F.sum(F.col("weight") * F.col("gain"))).alias("text_match"))
    )
    best = top_per_key(scores, ["query_id"], [F.desc("text_match"), F.asc("doc_id")], k, rank="rank")
    return best.select("query_id", "rank", "doc_id", "text_match")


def text_search(docs: DataFrame, queries: DataFrame, k: int = LIMIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Best ``k`` of ``docs`` (doc_id, text) for every row of ``queries`` (query_id, text).
    With more than ``broadcast_rows`` query words all joins are shuffle joins, with the same result.

    The postings of the query words are written once, with the length of every
    document, and read for the word frequencies, the mean length and the scores:
    texts are parsed once.
    """
    wanted = written(query_words(queries), "query-words")
    return rank_postings(asked_postings(docs, wanted, broadcast_rows), wanted, k, broadcast_rows=broadcast_rows)


def asked_vocabulary(wanted: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``wanted`` words and the anchor, to be broadcast if they were counted to be few."""
    anchor = wanted.sparkSession.createDataFrame([(ANCHOR,)], "word string")
    vocabulary = wanted.select("word").distinct().unionByName(anchor)
    return F.broadcast(vocabulary) if is_small(wanted, broadcast_rows) else vocabulary


def asked_postings(docs: DataFrame, wanted: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Anchored postings of the ``wanted`` words, written once."""
    return written(build_postings(docs, asked_vocabulary(wanted, broadcast_rows), anchored=True), "postings")


def with_attributes(results: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Add attribute columns of the found documents."""
    return docs.select("doc_id", *columns).join(results, "doc_id")


def search_interactions(
    interaction: DataFrame, queries: DataFrame, k: int = LIMIT, only: Column | None = None
) -> DataFrame:
    """Best ``k`` transcripts per query with their attributes.

    ``only`` narrows the search by attributes, for example to one customer, before
    the texts are read.
    """
    docs = search_source(interaction).withColumnRenamed("interaction_id", "doc_id")
    docs = (docs if only is None else docs.filter(only)).filter(F.col("text").isNotNull())
    found = with_attributes(
        text_search(docs, queries, k), docs, "customer_id", "interaction_type", "interaction_timestamp"
    )
    return found.withColumnRenamed("doc_id", "interaction_id")


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


# Vectors of a batch that are compared with QUERY_BLOCK queries at a time.
VECTOR_BLOCK, QUERY_BLOCK = 4_096, 256


def _batch_best(ids: np.ndarray, corpus: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of one batch per query, by rounded score and then id.

    Works on small sub-blocks and keeps a running best, so memory does not
    depend on how many vectors and queries meet.
    """
    parts = []
    order = np.argsort(ids, kind="stable")  # equal scores go to the smaller id
    for q in range(0, len(query_ids), QUERY_BLOCK):
        block = queries[q : q + QUERY_BLOCK]
        best = np.empty((0, len(block))), np.empty((0, len(block)), dtype=np.int64)
        for v in range(0, len(order), VECTOR_BLOCK):
            at = order[v : v + VECTOR_BLOCK]
            scores = np.vstack((best[0], np.floor(corpus[at] @ block.T * 1e6 + 0.5) / 1e6))
            rows = np.vstack((best[1], np.repeat(at[:, None], len(block), axis=1)))
            keep = np.argsort(-scores, axis=0, kind="stable")[:k]
            best = np.take_along_axis(scores, keep, axis=0), np.take_along_axis(rows, keep, axis=0)
        n = len(best[0])
        parts.append(
            pd.DataFrame(
                {
                    "query_id": np.repeat(query_ids[q : q + QUERY_BLOCK], n),
                    "vec_id": ids[best[1].T.ravel()],
                    "cosine_similarity": best[0].T.ravel(),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def vector_search(
    corpus: DataFrame, queries: DataFrame, k: int = LIMIT, slices: int | None = None, only: Column | None = None,
    broadcast_vectors: int | None = None,
) -> DataFrame:
    """Exact cosine top ``k`` of ``corpus`` (vec_id, embedding) per query (query_id, embedding).

    Ids keep their types, long or string. Vectors that are NULL are not found
    and not asked. ``only`` narrows the corpus by its attributes before vectors
    are read. Each task multiplies its batches with the query matrix and hands
    on only its best ``k`` per query, so pairs are never written out. Query sets
    too large to send to every task (``broadcast_vectors``) go through a grid of
    corpus slices and query blocks, with the same result.
    """
    most = BROADCAST_VECTORS if broadcast_vectors is None else broadcast_vectors
    corpus = (corpus if only is None else corpus.filter(only)).select("vec_id", "embedding").filter("embedding IS NOT NULL")
    queries = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (corpus, "vec_id"))]
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, cosine_similarity double"
    head = queries.limit(most + 1).toPandas()
    if len(head) <= most:
        ids = head["query_id"].to_numpy()
        matrix = _unit(head["embedding"]) if len(ids) else None

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(ids):
                    yield _batch_best(batch["vec_id"].to_numpy(), _unit(batch["embedding"]), ids, matrix, k)

        best = corpus.mapInPandas(score, schema)
    else:
        best = _grid_search(corpus, queries, k, slices, schema, max(1, most))
    order = [F.desc("cosine_similarity"), F.asc("vec_id")]
    return top_per_key(best, ["query_id"], order, k, rank="rank").select(
        "query_id", "rank", "vec_id", "cosine_similarity"
    )


def _grid_search(
    corpus: DataFrame, queries: DataFrame, k: int, slices: int | None, schema: str, block: int
) -> DataFrame:
    """Every (slice, block) cell sees each of its vectors once and returns its best ``k`` per query."""
    blocks = queries.count() // block + 1
    slices = slices or corpus.count() // 100_000 + 1
    left = corpus.select(
        "vec_id", "embedding",
        F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    right = queries.select(
        "query_id", "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
    )

    def cell(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine_similarity": []})
        return _batch_best(
            vectors["vec_id"].to_numpy(), _unit(vectors["embedding"]), wanted["query_id"].to_numpy(), _unit(wanted["embedding"]), k
        )

    return (
        left.groupBy("slice", "block")
        .cogroup(right.groupBy("slice", "block"))
        .applyInPandas(cell, schema)
    )


# Largest number of phrases that become constants of the projection.
PHRASE_CONSTANTS = 1_000


def substring_search(docs: DataFrame, phrases: list[str] | DataFrame) -> DataFrame:
    """(phrase, doc_id) of every document containing a phrase, ignoring case.

    Phrases are a list or a table with a ``phrase`` column; NULL and empty ones
    ask for nothing. Those of a short list are constants of the projection, so each text is lowered and read
    once and no join is needed. Tables and longer lists go through ``phrases.phrase_search``, which reads the texts once too.
    """
    from .phrases import phrase_search

    if isinstance(phrases, DataFrame):
        return phrase_search(docs, phrases)
    phrases = list(dict.fromkeys(p for p in phrases if p))
    if len(phrases) > PHRASE_CONSTANTS:
        return phrase_search(docs, docs.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string"))
    found = [F.when(F.contains(F.col("lowered"), F.lit(p.lower())), F.lit(p)) for p in phrases]
    listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    lowered = docs.select("doc_id", F.lower("text").alias("lowered"))
    return lowered.select("doc_id", F.explode(listed).alias("phrase"))
