"""What a conversation says: tone, intent, signals, summary, key phrases.

Input is one row per turn (interaction_id, turn_no, speaker, text). Words are
scored next to their text and summed per interaction with map-side combine, so
neither a long conversation nor a frequent word gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts
from ..functions.counting import best_sentences
from ..functions.lexicon import ANCHOR, DEFAULT_INTENT, INTENTS, SERVICE_ENGLISH, Lexicon
from ..functions.rules import retention_risk, sentiment_label
from ..functions.text import is_blank, sentences, words
from ..session import written
from .customer360 import split_repeated, top_per_key

SUMMARY_SENTENCES = 3
KEY_PHRASES = 5


def lexicon_hits(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per interaction with every lexicon sum, from one pass over the text.

    The lexicon comes as one row of numbers per word, so the join drops all other
    words and what is left is added up without any condition. An anchor word per
    turn keeps interactions without a hit.
    """
    rows = turns.select(
        "interaction_id",
        (F.col("speaker") == "Customer").cast("double").alias("by_customer"),
        (~is_blank(F.col("text"))).cast("int").alias("readable"),
        F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("found"),
    ).select(
        "interaction_id", "by_customer", "readable", F.explode(F.concat(F.array(F.lit(ANCHOR)), "found")).alias("word")
    )
    sums = [
        F.expr(f"sum({c} * by_customer)" if c.startswith("signal_") else f"sum({c})").alias(c)
        for c in lexicon.columns()
    ]
    blank = (F.max("readable") == 0).alias("blank")
    return rows.join(lexicon.frame(turns.sparkSession), "word").groupBy("interaction_id").agg(*sums, blank)


# Mean weight of the matched words within -1..1; 0 when no word matches.
SENTIMENT_SQL = "coalesce(greatest(-1D, least(1D, tone_sum / nullif(tone_hits, 0))), 0D)"
# Half away from zero at four digits, the same in every engine.
SHOWN_SENTIMENT_SQL = "signum(sentiment) * floor(abs(sentiment) * 10000 + 0.5D) / 10000D"


def intent_label(lexicon: Lexicon) -> Column:
    """Label with the most hits; ties go to the earlier label, no hit to the default."""
    labels = [name for name in INTENTS if name in lexicon.intent]
    best = f"greatest({', '.join(f'intent_{name}' for name in labels)}, 0)"
    chain = " ".join(f"WHEN intent_{name} = {best} THEN '{name}'" for name in labels)
    return F.expr(f"CASE WHEN {best} = 0 THEN '{DEFAULT_INTENT}' {chain} ELSE '{DEFAULT_INTENT}' END")


def level(hits: str, levels: tuple[tuple[str, int], ...], none: str) -> Column:
    chain = " ".join(f"WHEN {hits} >= {least} THEN '{name}'" for name, least in levels)
    return F.expr(f"CASE {chain} ELSE '{none}' END")


def score_interactions(turns: DataFrame, lexicon: Lexicon = SERVICE_ENGLISH) -> DataFrame:
    """Sentiment, intent, signals and retention risk per interaction."""
    return scores_and_blanks(turns, lexicon).drop("blank")


def scores_and_blanks(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The scores, and whether no turn of the interaction can be read, from one pass over the text."""
    raised = {name: F.expr(f"signal_{name} >= {hits}") for name, hits in lexicon.concern_hits.items()}
    scored = lexicon_hits(turns, lexicon).select(
        "interaction_id",
        "blank",
        F.expr(SENTIMENT_SQL).alias("sentiment"),
        intent_label(lexicon).alias("intent"),
        level("signal_urgency", lexicon.urgency_levels, "low").alias("urgency"),
        level("signal_churn", lexicon.churn_levels, "none").alias("churn_signal"),
        raised["pricing"].alias("pricing_concern"),
        raised["coverage"].alias("coverage_concern"),
        raised["complaint"].alias("complaint_signal"),
    )
    pressing = "urgency IN ('critical', 'high')"
    worried = "(pricing_concern OR coverage_concern)"
    tone = (
        f"CASE WHEN churn_signal = 'high' THEN 'retention-focused' WHEN {pressing} THEN 'urgent' "
        f"WHEN complaint_signal THEN 'empathetic' WHEN {worried} THEN 'reassuring' ELSE 'informational' END"
    )
    emotion = (
        f"CASE WHEN complaint_signal AND sentiment < -0.3D THEN 'angry' WHEN complaint_signal THEN 'frustrated' "
        f"WHEN {pressing} THEN 'anxious' WHEN {worried} THEN 'concerned' "
        "WHEN sentiment > 0.3D THEN 'satisfied' ELSE 'calm' END"
    )
    return scored.select(
        "interaction_id",
        F.expr(SHOWN_SENTIMENT_SQL).alias("sentiment"),
        sentiment_label("sentiment").alias("sentiment_label"),
        "intent", "urgency", "churn_signal", "pricing_concern", "coverage_concern", "complaint_signal",
        F.expr(tone).alias("recommended_tone"),
        F.expr(emotion).alias("customer_emotion"),
        retention_risk("churn_signal", "sentiment").alias("retention_risk"),
        "blank",
    )


def sentence_rows(turns: DataFrame) -> DataFrame:
    return turns.select(
        "interaction_id", "turn_no", "speaker",
        F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"),
    )


def summary_sentences(
    turns: DataFrame, n: int = SUMMARY_SENTENCES, one_row_each: bool = False, numbered: DataFrame | None = None
) -> DataFrame:
    """The ``n`` sentences with the highest mean word frequency of each interaction.

    Word counts are combined before they are shuffled, and the frequency of a
    word comes back by a join whose large side may be split, so a long text with
    a frequent word does not become one task. Texts that are one row each
    (documents) are scored in their rows instead and not shuffled at all; those
    whose id comes again go with the others. ``numbered``
    are the sentences of ``turns`` if they have been written already.
    """
    if one_row_each:
        single, repeated = split_repeated(turns, ["interaction_id"])
        best = _row_sentences(single, n)
        return best if repeated is None else best.unionByName(summary_sentences(repeated, n))
    numbered = sentence_rows(turns) if numbered is None else numbered
    place = ["interaction_id", "turn_no", "sentence_no"]
    counts = (
        numbered.select(*place, F.explode(words(F.col("sentence"))).alias("word"))
        .groupBy(*place, "word")
        .agg(F.count("*").alias("n"))
    )
    frequency = counts.groupBy("interaction_id", "word").agg(F.sum("n").alias("frequency"))
    # The size of unfolded words cannot be estimated from the texts: never broadcast them.
    weighed = counts.join(frequency.hint("merge"), ["interaction_id", "word"])
    scores = weighed.groupBy(*place).agg((F.sum(F.col("n") * F.col("frequency")) / F.sum("n")).alias("score"))
    best = top_per_key(
        scores, ["interaction_id"], [F.desc("score"), F.asc("turn_no"), F.asc("sentence_no")], n
    )
    return numbered.join(best, place).select(*place, "sentence", "score")


def _row_sentences(turns: DataFrame, n: int) -> DataFrame:
    """``summary_sentences`` of interactions that are one row each."""
    place = ["interaction_id", "turn_no"]
    found = turns.filter("interaction_id IS NOT NULL AND turn_no IS NOT NULL AND text IS NOT NULL").select(
        *place, sentences(F.col("text")).alias("listed")
    ).select(*place, "listed", F.transform("listed", words).alias("found"))
    kinds = [f"{c} {turns.schema[c].dataType.simpleString()}" for c in place]
    schema = ", ".join([*kinds, "sentence_no int, sentence string, score double"])
    return found.mapInArrow(best_sentences(place, n), schema)


def summarize(
    turns: DataFrame, n: int = SUMMARY_SENTENCES, one_row_each: bool = False, numbered: DataFrame | None = None
) -> DataFrame:
    """Extractive summary: the best sentences in text order. At most ``n`` per group."""
    chosen = F.array_sort(F.collect_list(F.struct("turn_no", "sentence_no", "sentence")))
    return (
        summary_sentences(turns, n, one_row_each, numbered)
        .groupBy("interaction_id")
        .agg(F.array_join(F.transform(chosen, lambda s: s["sentence"]), " ").alias("summary"))
    )


def key_phrases(
    turns: DataFrame, lexicon: Lexicon = SERVICE_ENGLISH, n: int = KEY_PHRASES, numbered: DataFrame | None = None
) -> DataFrame:
    """Customer sentences with the most signal words: (interaction_id, rank, phrase, hits)."""
    signal_words = sorted({w for ws in lexicon.signal.values() for w in ws})
    hits = F.size(F.filter(words(F.col("sentence")), lambda w: w.isin(*signal_words)))
    said = sentence_rows(turns) if numbered is None else numbered
    spoken = said.filter("speaker = 'Customer'").withColumn("hits", hits).filter("hits > 0")
    order = [F.desc("hits"), F.asc("turn_no"), F.asc("sentence_no")]
    return top_per_key(spoken, ["interaction_id"], order, n, rank="rank").select(
        "interaction_id", "rank", F.col("sentence").alias("phrase"), F.col("hits").cast("long").alias("hits")
    )


def phrase_lists(phrases: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", "phrase")))
    return phrases.groupBy("interaction_id").agg(
        F.transform(ranked, lambda p: p["phrase"]).alias("key_phrases")
    )


def blank_interactions(turns: DataFrame) -> DataFrame:
    """Interactions with no readable text in any turn."""
    return turns.groupBy("interaction_id").agg(F.bool_and(is_blank(F.col("text"))).alias("blank"))


def analyze_interactions(
    requests: DataFrame,
    headers: DataFrame,
    turns: DataFrame,
    customer: DataFrame,
    lexicon: Lexicon = SERVICE_ENGLISH,
    scores: DataFrame | None = None,
    with_quotes: bool = True,
) -> DataFrame:
    """(interaction_id, customer_id, status, doc) for every requested interaction.

    ``scores`` may replace the default scoring by a model's results of the same
    columns, one row per interaction. Without ``with_quotes`` the summary and the
    key phrases stay NULL and their work is saved, for readers that only need
    the signals.
    """
    if scores is None:
        scores = scores_and_blanks(turns, lexicon)
    else:
        scores = scores.join(blank_interactions(turns), "interaction_id", "full")
    known = headers.join(
        customer.select("customer_id", F.col("name").alias("customer_name")), "customer_id"
    ).withColumn("known", F.lit(True))
    joined = (
        requests.select("interaction_id")
        .join(known, "interaction_id", "left")
        .join(scores, "interaction_id", "left")
    )
    if with_quotes:
        numbered = written(sentence_rows(turns), "sentences")  # read for word counts, summaries and phrases
        joined = joined.join(summarize(turns, numbered=numbered), "interaction_id", "left").join(
            phrase_lists(key_phrases(turns, lexicon, numbered=numbered)), "interaction_id", "left"
        )
        summary, phrases = "coalesce(summary, '')", "coalesce(key_phrases, cast(array() AS array<string>))"
    else:
        summary, phrases = "cast(NULL AS string)", "cast(NULL AS array<string>)"
    status = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.coalesce("blank", F.lit(True)), "empty_transcript")
        .otherwise("ok")
    )
    message = F.when(status == "not_found", texts.INTERACTION_NOT_FOUND).when(
        status == "empty_transcript", texts.EMPTY_TRANSCRIPT
    )
    ok = status == "ok"

    def when_ok(column: Column) -> Column:
        return F.when(ok, column)

    doc = F.struct(
        status.alias("status"), "interaction_id", "customer_id", message.alias("message"),
        when_ok(F.col("customer_name")).alias("customer_name"),
        when_ok(F.col("interaction_type")).alias("interaction_type"),
        when_ok(F.col("interaction_timestamp")).alias("interaction_timestamp"),
        when_ok(F.col("agent_note")).alias("agent_note"),
        when_ok(
            F.struct(F.col("sentiment").alias("score"), F.col("sentiment_label").alias("label"))
        ).alias("sentiment"),
        when_ok(
            F.struct(F.struct(F.col("intent").alias("label")).alias("raw"), F.col("intent").alias("label"))
        ).alias("intent"),
        when_ok(F.expr(summary)).alias("summary"),
        when_ok(
            F.struct(
                "urgency", "churn_signal", "pricing_concern", "coverage_concern", "complaint_signal",
                "recommended_tone", "customer_emotion",
            )
        ).alias("signals"),
        when_ok(F.expr(phrases)).alias("key_phrases"),
        when_ok(F.col("retention_risk")).alias("retention_risk"),
    )
    return joined.select("interaction_id", "customer_id", status.alias("status"), doc.alias("doc"))


ModelFn = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(df: DataFrame, model: ModelFn, schema: T.StructType | str, version: str,
                done: DataFrame | None = None) -> DataFrame:
    """Run a user's model over rows in Arrow batches.

    ``model`` takes and returns pandas frames carrying ``interaction_id``.
    Results are stamped with the model version; rows already scored by that
    version (``done``) are skipped, so a re-run only scores new ones.
    """
    if done is not None:
        seen = done.filter(F.col("model_version") == version).select("interaction_id").distinct()
        df = df.join(seen, "interaction_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema).withColumn("model_version", F.lit(version))
