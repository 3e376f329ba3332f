"""Registered queries: every product over the whole sales tables, as flat columns.

Each entry takes (spark, sf_dir). Results hold only long, double, string and
boolean columns so that they can be compared with SQL value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import model_json
from ..functions.display import title_case
from ..functions.lexicon import Lexicon
from ..functions.text import dialogue_turns
from ..operators import actions, customer360, decide, interactions, phrases, policy, quality, risk, search, topk, vector_index
from ..session import shared_folder, written
from ..sources import bucketed, sales
from ..sources.schemas import PRIMARY_KEYS
from ..sources.tables import (
    Tables, append_rows, conform, from_documents, literal_rows, read_table, replace_table, to_documents,
)
from ..streaming import alerts, feeds, segments

Query = Callable[[SparkSession, str], DataFrame]

# Words that occur in the conversation and document texts, which are invented prose.
PROSE = Lexicon(
    sentiment={
        "with": 1.0, "and": 0.5, "was": 0.25, "und": 1.0, "la": 0.5, "les": 0.75, "los": 0.5, "by": 0.75,
        "from": -1.0, "is": -0.5, "that": -0.25, "nicht": -1.0, "der": -0.5, "de": -0.25, "en": -0.75, "it": -0.75,
    },
    intent={
        "renewal_inquiry": ("the", "of"),
        "claim_status": ("der", "die", "und", "den"),
        "billing_question": ("la", "le", "les", "une"),
        "cancellation_request": ("que", "el", "los", "por"),
        "coverage_concern": ("to", "in", "is"),
        "complaint": ("that", "it", "was"),
    },
    signal={
        "churn": ("from", "auf", "elle", "del", "then"),
        "urgency": ("this", "sich", "des", "mit", "es", "at"),
        "pricing": ("with", "das", "au", "las"),
        "coverage": ("are", "ein", "dans", "por"),
        "complaint": ("be", "nicht", "qui", "con"),
    },
)
PHRASES = ["the thing", "nicht", "elle", "of the", "100%", "a_b"]
STATUS_OF = ("PENDING", "EXECUTED", "DECLINED", "ESCALATED")
# Customers with more homes or policies than this are spread, in the queries over pooled holdings.
HOUSEHOLD_HOT = 2


def flat(df: DataFrame) -> DataFrame:
    """Numbers to long or double, dates and times to text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)


def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as requested customers: some of them do not exist."""
    return sales.scan(spark, sf_dir, "part").select(F.col("p_partkey").alias("customer_id"))


def _tables(fn: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: flat(fn(sales.sales_tables(spark, sf_dir)))


def _pooled(fn: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: flat(fn(sales.household_tables(spark, sf_dir)))


def _comparison(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _tables(lambda t: fn(policy.policy_comparison(t)))


def _policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.compare_policy(sales.sales_tables(spark, sf_dir), requested_ids(spark, sf_dir))


def _pooled_policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.compare_policy(sales.household_tables(spark, sf_dir), requested_ids(spark, sf_dir), HOUSEHOLD_HOT)


def _risk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.analyze_risk(sales.sales_tables(spark, sf_dir), requested_ids(spark, sf_dir))


def _pooled_risk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.analyze_risk(sales.household_tables(spark, sf_dir), requested_ids(spark, sf_dir), HOUSEHOLD_HOT)


def exclusion_diff(comparison: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.lit("added").alias("change"), F.col("exclusions_added").alias("items")),
        F.struct(F.lit("removed").alias("change"), F.col("exclusions_removed").alias("items")),
    )
    return comparison.select("customer_id", "policy_id", F.inline(sides)).select(
        "customer_id", "policy_id", "change", F.explode("items").alias("item")
    )


def _flat_policy_docs(docs: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = F.col("doc")
        fields = ("current", "renewal", "change", "change_pct", "severity")
        blocks = [d[block][f].alias(f"{block}_{f}") for block in policy.BLOCKS for f in fields]
        excluded = [d["exclusions"][f].alias(f"exclusions_{f}") for f in ("current", "renewal", "changed")]
        listed = [F.array_join(F.array_sort(d["exclusions"][f]), "|").alias(f"exclusions_{f}") for f in ("added", "removed")]
        dates = [d["dates"][f].alias(f) for f in ("current_effective", "current_expiry", "renewal_effective", "renewal_expiry")]
        return flat(
            docs(spark, sf_dir).select(
                "customer_id", "status", d["customer_name"].alias("customer_name"), d["message"].alias("message"),
                d["policy_id"].alias("policy_id"), *blocks, *excluded, *listed, *dates,
                d["overall_severity"].alias("overall_severity"),
                F.array_join("doc.key_findings", "\n").alias("findings"),
            )
        )

    return query


def _flat_risk_docs(docs: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, impact = F.col("doc"), F.col("doc")["policy_impact"]
        assessment = ("assessment_id", "assessment_date", "flood_risk", "fire_risk", "earthquake_risk", "overall_risk_score", "risk_reason")
        sides = [d[f"{side}_assessment"][f].alias(f"{side}_{f}") for side in ("previous", "current") for f in assessment]
        only = [d["current_risk"][f].alias(f"only_{f}") for f in assessment[1:]]
        changes = [d["changes"][x][f].alias(f"{x}_{f}") for x in ("flood", "fire", "earthquake") for f in ("previous", "current", "direction")]
        scores = [d["changes"]["overall_score"][f].alias(f"score_{f}") for f in ("previous", "current", "change", "change_pct", "direction")]
        effects = [
            impact[f].alias(f"impact_{f}")
            for f in (
                "policy_id", "premium_change_pct", "premium_change", "flood_coverage_change_pct", "flood_coverage_change",
                "flood_deductible_change_pct", "flood_deductible_change", "exclusions_changed", "overall_severity", "message",
            )
        ]
        return flat(
            docs(spark, sf_dir).select(
                "customer_id", "status", d["message"].alias("message"), d["property_id"].alias("property_id"),
                d["location"].alias("location"), d["property_type"].alias("property_type"), *sides, *only, *changes, *scores,
                d["root_cause"].alias("root_cause"), *effects,
                F.array_join("doc.causal_chain", "\n").alias("causes"),
                F.array_join("doc.communication_points", "\n").alias("points"),
            )
        )

    return query


def _exploded(docs: Query, column: str, name: str) -> Query:
    return lambda spark, sf_dir: flat(
        docs(spark, sf_dir).select("customer_id", F.posexplode(column).alias("position", name))
    )


def _scores(*columns: str) -> Query:
    return lambda spark, sf_dir: flat(
        interactions.score_interactions(sales.conversation_turns(spark, sf_dir), PROSE).select(
            "interaction_id", *columns
        )
    )


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(interactions.summarize(sales.document_turns(spark, sf_dir), one_row_each=True))


def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(interactions.key_phrases(sales.conversation_turns(spark, sf_dir), PROSE))


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(interactions.score_interactions(sales.document_turns(spark, sf_dir), PROSE))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten as transcripts, line by line in turn, and split again; every third opens with a subject."""
    return flat(dialogue_turns(_transcripts(spark, sf_dir)).select("interaction_id", "turn_no", "speaker", "subject", "text"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Subject: "), "source", F.lit("\n"))).otherwise("")
    label = lambda line, i: F.concat(
        F.when(i % 2 == 0, "Customer: ").otherwise("Agent: "), F.when(i == 0, subject).otherwise(""), line
    )
    transcript = F.array_join(F.transform(F.split("text", "\n"), label), "\n")
    return sales.scan(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("interaction_id"), transcript.alias("raw_transcript")
    )


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses made from the event properties: valid, partial, fenced, broken, blank, absent."""
    case = F.col("event_id") % 6
    k = F.get_json_object("props", "$.k").cast("int")
    urgency = F.when(k >= 67, "high").when(k >= 34, "medium").otherwise("low")
    full = F.concat(
        F.lit('{"urgency": "'), urgency, F.lit('", "churn_signal": "'), F.col("event_type"),
        F.lit('", "pricing_concern": '), F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit(', "key_phrases": ["'), F.col("event_type"), F.lit('", "'), k.cast("string"), F.lit('"]}'),
    )
    raw = (
        F.when(case == 0, full)
        .when(case == 1, F.col("props"))
        .when(case == 2, F.concat(F.lit("```json "), "props", F.lit("```")))
        .when(case == 3, F.substring("props", 1, 5))
        .when(case == 4, F.lit(" "))
    )
    return sales.scan(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), raw.alias("raw"))


def model_json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = model_json.with_signals(_responses(spark, sf_dir), "raw", out="s")
    return flat(
        read.select(
            "event_id",
            *[F.col(f"s.{n}").alias(n) for n, kind, _ in model_json.SIGNAL_FIELDS if "array" not in kind],
            F.array_join("s.key_phrases", "|").alias("key_phrases"),
            "s.parse_error",
            "s.raw_output",
        )
    )


def recommendation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First response, retry and default record, chosen per event."""
    good = F.concat(
        F.lit('{"recommended_action": {"code": "'), F.substring(F.lit("ABCDEFG"), F.col("k") % 7 + 1, 1),
        F.lit('", "title": "'), F.col("event_type"), F.lit('"}, "evidence": ["'), F.col("k").cast("string"), F.lit('"]}'),
    )
    case = F.col("event_id") % 5
    broken = F.concat(F.lit("{oops "), F.col("event_type"))
    primary = F.when(case.isin(0, 3), good).when(case == 4, F.lit("")).otherwise(broken)
    retry = F.when(case == 1, good).when(case == 2, broken)
    responses = _responses(spark, sf_dir).select("event_id", primary.alias("primary"), retry.alias("retry"))
    nba = F.col("nba")
    return flat(
        decide.recommend_from_model(responses).select(
            "event_id",
            *[nba["recommended_action"][f].alias(f) for f in ("code", "title", "description", "priority")],
            nba["why_this_action"].alias("why_this_action"),
            F.array_join(nba["evidence"], "|").alias("evidence"),
            F.size(nba["alternative_actions"]).alias("alternatives"),
            F.array_join(nba["risk_flags"], "|").alias("risk_flags"),
            nba["parse_error"].alias("parse_error"),
            nba["raw_output"].alias("raw_output"),
        )
    )


def _interaction_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers as requested interactions: most of them do not exist."""
    requests = sales.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("interaction_id"))
    return interactions.analyze_interactions(
        requests,
        sales.conversation_headers(spark, sf_dir),
        sales.conversation_turns(spark, sf_dir),
        sales.customers(spark, sf_dir),
        PROSE,
    )


def interaction_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc")
    return flat(
        _interaction_docs(spark, sf_dir).select(
            "interaction_id", "status", "customer_id",
            d["message"].alias("message"), d["customer_name"].alias("customer_name"),
            d["sentiment"]["score"].alias("sentiment"), d["sentiment"]["label"].alias("sentiment_label"),
            title_case(d["intent"]["label"]).alias("intent_title"),
            d["signals"]["urgency"].alias("urgency"), d["signals"]["churn_signal"].alias("churn_signal"),
            title_case(d["signals"]["recommended_tone"]).alias("tone_title"),
            d["signals"]["customer_emotion"].alias("customer_emotion"),
            d["retention_risk"].alias("retention_risk"),
            F.array_join(d["key_phrases"], " | ").alias("key_phrases"),
            d["summary"].alias("summary"), d["interaction_type"].alias("interaction_type"),
            *[d["signals"][c].alias(c) for c in ("pricing_concern", "coverage_concern", "complaint_signal")],
        )
    )


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and benchmark items as queries."""
    docs = sales.scan(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs, sales.scan(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_search(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    docs, queries = _searched(spark, sf_dir)
    return flat(search.with_attributes(search.text_search(docs, queries, **more), docs, "lang", "source"))


def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, of documents that can reach the first five alone."""
    docs, queries = _searched(spark, sf_dir)
    return flat(search.with_attributes(topk.bounded_text_search(docs, queries), docs, "lang", "source"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label, the request side of the vector search."""
    parts = sales.scan(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"]).alias("embedding")
    )


def vector_search(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    corpus = sales.scan(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return flat(search.vector_search(corpus, label_centroids(spark, sf_dir), **more))


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.substring_search(sales.scan(spark, sf_dir, "documents"), PHRASES))


def _context(
    spark: SparkSession, sf_dir: str, requests: DataFrame | None = None, with_quotes: bool = False
) -> DataFrame:
    """Decision context of every customer; the conversation of the same number, if any, is the request's."""
    headers = written(sales.conversation_headers(spark, sf_dir), "conversations")
    talks = headers.select("interaction_id", "customer_id")
    base = sales.customers(spark, sf_dir).select("customer_id") if requests is None else requests
    docs = interactions.analyze_interactions(
        talks, headers, sales.conversation_turns(spark, sf_dir),
        sales.customers(spark, sf_dir), PROSE, with_quotes=with_quotes,
    )
    return decide.nba_context(
        sales.sales_tables(spark, sf_dir, stored=("policy_version",)), base.join(talks, "customer_id", "left"), docs
    )


def nba_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(
        _context(spark, sf_dir, requested_ids(spark, sf_dir)).select(
            "customer_id", "interaction_id",
            F.col("customer_360.name").alias("name"),
            F.col("customer_360.total_claims").alias("total_claims"),
            F.col("customer_360.current_risk_score").alias("current_risk_score"),
            F.col("policy_comparison.status").alias("policy_status"),
            F.col("risk_analysis.status").alias("risk_status"),
            F.col("interaction_intelligence.status").alias("interaction_status"),
            F.col("interaction_intelligence.retention_risk").alias("retention_risk"),
        )
    )


def nba_context_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for customers with several homes and policies: all parts speak of the same two."""
    requests = requested_ids(spark, sf_dir).withColumn("interaction_id", F.lit(None).cast("long"))
    context = decide.nba_context(sales.household_tables(spark, sf_dir), requests)
    return flat(
        context.select(
            "customer_id", "property_id", "policy_id",
            F.col("customer_360.property_id").alias("described_property"),
            F.col("customer_360.policy_id").alias("described_policy"),
            F.col("policy_comparison.policy_id").alias("compared_policy"),
            F.col("risk_analysis.property_id").alias("changed_property"),
            F.col("risk_analysis.policy_impact.policy_id").alias("impact_policy"),
            F.col("customer_360.location").alias("location"),
            F.col("customer_360.current_risk_score").alias("current_risk_score"),
            F.col("risk_analysis.current_assessment.overall_risk_score").alias("changed_score"),
            F.col("policy_comparison.status").alias("policy_status"),
            F.col("risk_analysis.status").alias("risk_status"),
        )
    )


def nba_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, read back section by section."""
    section = lambda head: F.regexp_extract("prompt", rf"\n{head}:\n(\{{.*\}})\n", 1)
    person, terms, change, said = (section(h) for h in ("Customer", "Policy comparison", "Risk", "Last interaction"))
    menu = F.regexp_extract("prompt", r"(?s)choose from:\n(.*)\n\nAnswer", 1)
    text = lambda part, *paths: [F.get_json_object(part, f"$.{p}").alias(name) for p, name in paths]
    return flat(
        decide.build_prompts(_context(spark, sf_dir, with_quotes=True)).select(
            "customer_id", "interaction_id",
            F.get_json_object(person, "$.total_claims").cast("long").alias("total_claims"),
            *text(person, ("name", "name"), ("payment_history", "payment_history"), ("churn_risk_label", "churn_risk_label"),
                  ("location", "location"), ("policy_status", "customer_policy_status")),
            *text(terms, ("status", "policy_status"), ("overall_severity", "overall_severity"), ("premium.severity", "premium_severity"),
                  ("message", "policy_message")),
            *text(change, ("status", "risk_status"), ("changes.flood.direction", "flood_direction"), ("root_cause", "root_cause"),
                  ("message", "risk_message")),
            *text(said, ("status", "interaction_status"), ("sentiment.label", "tone"), ("intent.label", "intent"), ("summary", "summary")),
            menu.alias("menu"),
        )
    )


def nba_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(decide.candidate_rows(decide.score_candidates(_context(spark, sf_dir))).drop("title", "rank"))


def nba_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended action and the alternatives, with reasons."""
    nba = F.col("nba")
    rows = decide.recommend(decide.score_candidates(_context(spark, sf_dir)))
    alternative = lambda i, f: F.get(nba["alternative_actions"], i)[f]
    return flat(
        rows.select(
            "customer_id",
            nba["recommended_action"]["code"].alias("code"),
            nba["recommended_action"]["priority"].alias("priority"),
            alternative(0, "code").alias("second"),
            alternative(0, "why_not_selected").alias("second_reason"),
            alternative(1, "code").alias("third"),
            alternative(1, "why_not_selected").alias("third_reason"),
        )
    )


def nba_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nba = F.col("nba")
    rows = decide.recommend(decide.score_candidates(_context(spark, sf_dir)))
    return flat(
        rows.select(
            "customer_id",
            F.array_join(nba["evidence"], "\n").alias("facts"),
            F.array_join(nba["interpretation"], "\n").alias("interpretation"),
            F.array_join(nba["risk_flags"], "\n").alias("risk_flags"),
            F.array_join(nba["agent_talking_points"], "\n").alias("talking_points"),
        )
    )


def nba_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decide.next_best_action(_context(spark, sf_dir, requested_ids(spark, sf_dir), with_quotes=True))
    return flat(
        docs.select(
            "customer_id", "interaction_id", "status",
            F.col("doc.message").alias("message"),
            F.col("doc.customer_name").alias("customer_name"),
            F.col("doc.context.policy_comparison.status").alias("policy_status"),
            F.col("doc.context.risk_analysis.status").alias("risk_status"),
            F.col("doc.nba.recommended_action.code").alias("code"),
            F.col("doc.nba.recommended_action.title").alias("title"),
            F.col("doc.nba.recommended_action.description").alias("description"),
            F.col("doc.nba.recommended_action.priority").alias("priority"),
            F.col("doc.nba.why_this_action").alias("why"),
            F.array_join("doc.nba.agent_talking_points", "\n").alias("talking_points"),
            F.array_join("doc.nba.risk_flags", "\n").alias("risk_flags"),
            F.col("doc.context.customer_360.total_claims").alias("total_claims"),
            F.col("doc.context.interaction_intelligence.status").alias("interaction_status"),
            F.col("doc.context.interaction_intelligence.summary").alias("summary"),
        )
    )


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every requested customer, known or not."""
    status = F.element_at(
        F.array(*[F.lit(s) for s in STATUS_OF]), (F.col("customer_id") % len(STATUS_OF) + 1).cast("int")
    )
    recommended = decide.recommend(decide.score_candidates(_context(spark, sf_dir)))
    decided = actions.decisions(recommended, status).drop("status")
    asked = requested_ids(spark, sf_dir).join(decided, "customer_id", "left").withColumn("status", status)
    as_of = F.timestamp_seconds(F.lit(1709251200) + F.col("customer_id") % 3).cast("timestamp_ntz")
    return actions.validate_actions(asked, sales.customers(spark, sf_dir), as_of)


def _payload(rows: DataFrame) -> DataFrame:
    """The logged JSON read back field by field."""
    read = lambda path: F.get_json_object("recommended_action", f"$.{path}")
    action = [read(f"recommended_action.{f}").alias(f"action_{f}") for f in ("code", "title", "description", "priority")]
    evidence = F.array_join(F.from_json(read("evidence"), "array<string>"), "\n")
    return rows.select(
        *[c for c in rows.columns if c != "recommended_action"], *action, read("why_this_action").alias("why"), evidence.alias("evidence")
    )


def action_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_payload(actions.log_rows(_validated(spark, sf_dir))))


def action_log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of the same seconds appended to one log and read back, with their confirmations."""
    root = shared_folder(spark, "log")
    customer = sales.customers(spark, sf_dir)
    key = F.col("customer_id")
    asked = requested_ids(spark, sf_dir).select(
        key, key.alias("interaction_id"), F.lit("{}").alias("recommended_action"),
        F.concat(F.lit("Call "), key.cast("string")).alias("action_taken"), F.lit("PENDING").alias("status"),
    )
    as_of = F.timestamp_seconds(F.lit(1709251200) + key % 3).cast("timestamp_ntz")
    results = []
    for batch in (0, 1):
        existing = read_table(spark, root, "action_log") if batch else None
        checked = actions.validate_actions(asked.filter(key % 2 == batch), customer, as_of, existing)
        actions.append_actions(checked, root)
        results.append(actions.log_results(checked))
    confirmed = results[0].unionByName(results[1]).filter("status = 'ok'").select("action_id", F.lit(True).alias("confirmed"))
    log = read_table(spark, root, "action_log").join(confirmed, "action_id", "left")
    number = F.element_at(F.split("action_id", "-"), 4).cast("long")
    return flat(
        log.select("action_id", F.col("customer_id").cast("long"), "action_taken", "status", "action_timestamp", "confirmed", number.alias("number"))
    )


def action_log_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs that number their actions at the same time, before any of them appends; then one more."""
    root, customer = shared_folder(spark, "log"), sales.customers(spark, sf_dir)
    key = F.col("customer_id")
    asked = requested_ids(spark, sf_dir).select(
        key, key.alias("interaction_id"), F.lit("{}").alias("recommended_action"), F.lit("Call").alias("action_taken"), F.lit("PENDING").alias("status"),
    )
    as_of = F.timestamp_seconds(F.lit(1709251200) + key % 3).cast("timestamp_ntz")
    part = lambda n: asked.filter(F.pmod(key, F.lit(4)) == n)
    for checked in [actions.validate_actions(part(n), customer, as_of, writer=n, writers=3) for n in range(3)]:
        actions.append_actions(checked, root)
    actions.append_actions(actions.validate_actions(part(3), customer, as_of, read_table(spark, root, "action_log")), root)
    log = read_table(spark, root, "action_log")
    return flat(
        log.groupBy("action_timestamp").agg(F.count("*").alias("actions"), F.countDistinct("action_id").alias("ids"), F.countDistinct("customer_id").alias("customers"))
    )


def tables_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table written in part, replaced as a whole out of itself and its rest, appended to, and read back: rows and keys."""
    root, out = shared_folder(spark, "tables"), []
    for name, df in sales.sales_tables(spark, sf_dir).items():
        first = PRIMARY_KEYS[name][0]
        if name == "risk_history":  # scores made from amounts are wider than the contract's
            df = df.withColumn("overall_risk_score", F.col("overall_risk_score") % 10)
        part = F.pmod(F.xxhash64(F.col(first).cast("string")), F.lit(3))
        replace_table(df.filter(part == 0), root, name)
        replace_table(read_table(spark, root, name).unionByName(conform(df.filter(part == 1), name)), root, name)
        append_rows(df.filter(part == 2), root, name)
        back = read_table(spark, root, name)
        keys = [F.countDistinct(*PRIMARY_KEYS[name]).alias("keys"), F.min(first).alias("first_key"), F.max(first).alias("last_key")]
        out.append(back.agg(F.count("*").alias("n"), *keys).select(F.lit(name).alias("name"), "*"))
    return flat(reduce(DataFrame.unionByName, out))


def literal_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows given as literals, by position and by name, added to the customers."""
    root = shared_folder(spark, "literals")
    replace_table(sales.customers(spark, sf_dir), root, "customer")
    append_rows(literal_rows(spark, "customer", [("L1", "By position", 41, "3.5", "120.25", "GOOD", "0.50")]), root, "customer")
    append_rows(literal_rows(spark, "customer", [("By name", "L2")], ["name", "customer_id"]), root, "customer")
    return flat(read_table(spark, root, "customer").select("customer_id", "name", "age", "churn_risk_score", "payment_history"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON documents and back to columns."""
    customer = sales.customers(spark, sf_dir)
    fields = ["customer_id", "name", "churn_risk_score", "payment_history"]
    packed = to_documents(customer.select("customer_id", F.struct(*fields).alias("doc")), "doc", "customer_id")
    back = from_documents(packed, "doc", customer.select(*fields).schema)
    return flat(back.select("doc.*"))


def newest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest actions of all, numbered in their order."""
    history = actions.action_history(sales.action_log(spark, sf_dir), sales.customers(spark, sf_dir))
    top = actions.newest_first(history).limit(100)
    return flat(top.select("action_id", "customer_id", "status", "action_timestamp"))


def default_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(decide.default_requests(customer360.customer_360(sales.sales_tables(spark, sf_dir))))


def current_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that take the present time: all the same second, within an hour of now."""
    asked = requested_ids(spark, sf_dir).select(
        "customer_id", F.col("customer_id").alias("interaction_id"), F.lit("{}").alias("recommended_action"),
        F.lit("Call the customer back about the renewal").alias("action_taken"), F.lit("PENDING").alias("status"),
    )
    checked = actions.validate_actions(asked, sales.customers(spark, sf_dir)).filter("accepted")
    now = "cast(to_utc_timestamp(current_timestamp(), current_timezone()) AS timestamp_ntz)"  # whatever the zone of the session
    off = F.abs(F.expr(f"timestampdiff(SECOND, action_timestamp, {now})"))
    return flat(
        checked.select("customer_id", (off < 3600).alias("is_now"), actions.action_text(F.col("status"), F.lit("x"), F.col("action_taken"), length=8).alias("short_text"))
    )


def applied_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model over all documents, here one that counts characters; what one run has scored the next leaves alone."""
    texts = sales.scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("interaction_id"), "text")
    model = lambda frame: frame[["interaction_id"]].assign(characters=frame["text"].fillna("").str.len())
    apply = lambda df, **more: interactions.apply_model(df, model, "interaction_id long, characters long", "v1", **more)
    first = written(apply(texts.filter(F.length("text") < 2000)), "scored")
    return flat(first.unionByName(apply(texts, done=first)))


def action_log_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(actions.log_results(_validated(spark, sf_dir)))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks, with expectations about every 50th customer that hold for some and fail for others."""
    some = sales.customers(spark, sf_dir).filter("customer_id % 50 = 0").select("customer_id")
    worse = some.withColumns({"overall_severity": F.lit("MAJOR"), "exclusions_changed": F.lit(True)})
    risen = some.withColumn("overall_direction", F.lit("INCREASED"))
    moved = some.withColumns({"dimension": F.lit("flood"), "direction": F.lit("UP")})
    return flat(
        quality.quality_report(
            sales.sales_tables(spark, sf_dir, stored=("policy_version", "claim")), comparison_values=worse, change_values=risen, directions=moved
        )
    )


# Streaming queries -------------------------------------------------------------------


def _stream(spark: SparkSession, df: DataFrame, key: str, feed: Callable[[DataFrame], StreamingQuery], parts: int = 3) -> None:
    """Feeds ``df`` in several micro-batches; every tenth row comes again in the next one.

    Each arrives in as many files as its rows need and is taken up whole before the next; the feed goes on from its checkpoint.
    """
    folder = shared_folder(spark, "arriving")
    for part in range(parts):
        own = F.col(key) % parts == part
        again = (F.col(key) % parts == (part - 1) % parts) & (F.col(key) % 10 == 0) & F.lit(part > 0)
        df.filter(own | again).write.mode("append").parquet(folder)
        feed(feeds.stream_files(spark, folder, df.schema, "*.parquet")).awaitTermination()


def stream_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as timed transcripts of two speakers, some delivered twice."""
    out = shared_folder(spark, "interactions")
    contacts = _transcripts(spark, sf_dir).select(
        "interaction_id", F.timestamp_seconds(F.lit(1709251200) + F.col("interaction_id") % 3600).cast("timestamp_ntz").alias("interaction_timestamp"),
        F.col("raw_transcript").alias("text"),
    )
    _stream(spark, contacts, "interaction_id", lambda new: feeds.interaction_feed(new, f"{out}/rows", f"{out}/offsets", lexicon=PROSE))
    return flat(
        spark.read.parquet(f"{out}/rows").select(
            "interaction_id", "sentiment", "sentiment_label", "intent", "retention_risk"
        )
    )


def stream_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "postings")
    docs = sales.scan(spark, sf_dir, "documents").select("doc_id", "text")
    _stream(spark, docs, "doc_id", lambda new: feeds.postings_feed(new, f"{out}/rows", f"{out}/offsets"))
    return flat(feeds.latest_postings(spark, f"{out}/rows").select("doc_id", "word", "length", "tf"))


def stream_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over an index that a stream refreshed: outdated versions before and after the current ones, repeats, a merge on the way."""
    out, folder = shared_folder(spark, "index"), shared_folder(spark, "arriving")
    docs, queries = _searched(spark, sf_dir)
    now = docs.select("doc_id", "text", F.lit(1).alias("version"))
    old = now.withColumns({"text": F.concat(F.lit("outdated "), F.substring("text", 1, 500)), "version": F.lit(0)})
    part = F.pmod("doc_id", F.lit(3))
    arrivals = (
        now.filter(part == 0).union(old.filter((part == 2) & (F.col("doc_id") % 5 == 0))),
        now.filter(part == 1).union(now.filter((part == 0) & (F.col("doc_id") % 10 == 0))).union(old.filter((part == 0) & (F.col("doc_id") % 7 == 0))),
        now.filter(part == 2).union(old.filter((part == 1) & (F.col("doc_id") % 4 == 0))),
    )
    for n, rows in enumerate(arrivals):
        rows.write.mode("append").parquet(folder)
        arriving = feeds.stream_files(spark, folder, rows.schema, "*.parquet")
        segments.segment_feed(arriving, out, f"{out}/offsets", version="version").awaitTermination()
        if n == 1:
            segments.merge_segments(spark, out)
    return flat(search.with_attributes(segments.search_segments(spark, out, queries), docs, "lang", "source"))


def stream_risk_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "alerts")
    given = sales.risk_history(spark, sf_dir)
    _stream(spark, given, "risk_assessment_id", lambda new: feeds.risk_alert_feed(new, f"{out}/risk", f"{out}/offsets"))
    return _alerts(spark, f"{out}/risk")


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return flat(
        feeds.latest_risk_alerts(spark, folder).select(
            "property_id", "prev_assessment_id", "curr_assessment_id", "flood_direction", "fire_direction",
            "earthquake_direction", "risk_score_change", "risk_score_change_pct", "overall_direction",
        )
    )


def stream_risk_alerts_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts from keyed state."""
    out = shared_folder(spark, "state-alerts")
    given = sales.risk_history(spark, sf_dir)
    _stream(spark, given, "risk_assessment_id", lambda new: alerts.risk_alert_state_feed(new, f"{out}/risk", f"{out}/offsets"))
    return _alerts(spark, f"{out}/risk")


def stream_action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows by micro-batches; repeated deliveries of an action stay one row."""
    out = shared_folder(spark, "streamed-log")
    given = sales.action_log(spark, sf_dir)
    _stream(spark, given, "interaction_id", lambda new: feeds.action_log_feed(new, f"{out}/rows", f"{out}/offsets"))
    log = feeds.logged_actions(spark, f"{out}/rows")
    return flat(log.select("action_id", F.col("customer_id").cast("long"), "action_taken", "status", "action_timestamp"))


def stream_hourly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the arriving actions, every hour, late rows included."""
    out = shared_folder(spark, "hourly")
    logged = feeds.stream_files(spark, sf_dir, sales.scan(spark, sf_dir, "events").schema, "events.parquet")
    feeds.hourly_counts_feed(sales.logged_events(logged), f"{out}/rows", f"{out}/offsets").awaitTermination()
    return flat(feeds.hourly_counts(spark, f"{out}/rows"))


def search_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of calls that name a number, over the interaction table."""
    queries = sales.scan(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("k "), F.col("n_nationkey").cast("string")).alias("text")
    )
    return flat(search.search_interactions(sales.interactions(spark, sf_dir), queries, only=F.col("interaction_type") == "CALL"))


def vector_search_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of transcripts under text ids, narrowed by an attribute."""
    vectors = sales.scan(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("INT"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding", "label"
    )
    asked = label_centroids(spark, sf_dir).select(F.concat(F.lit("Q"), F.col("query_id").cast("string")).alias("query_id"), "embedding")
    return flat(search.vector_search(vectors, asked, only=F.col("label") < 5))


#: Buckets of the registered query; a cluster takes a small multiple of its cores.
BUCKETS = 32


def customer_360_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer product over tables that were written in buckets by customer."""
    names = bucketed.write_bucketed(sales.sales_tables(spark, sf_dir), shared_folder(spark, "bucketed"), BUCKETS)
    return flat(customer360.customer_360(bucketed.read_bucketed(spark, names), hot_rows=None))


def vector_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asked against an index of all, and whether brute force confirms what was found."""
    corpus = sales.scan(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = corpus.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.build_index(corpus, shared_folder(spark, "vector-index"))
    found = written(vector_index.search_index(index, asked), "neighbours")
    recall, exact = vector_index.measured_recall(corpus, asked, found)
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("results")).select(
        "*", F.lit(recall >= 0.9).alias("recall_reached"), F.lit(exact).alias("similarities_exact")
    )


def substring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases from a table: the first words of every benchmark item, and one that asks for nothing."""
    phrases = sales.scan(spark, sf_dir, "benchmark").select(
        F.when(F.col("item_id") > 0, F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("phrase")
    )
    return flat(search.substring_search(sales.scan(spark, sf_dir, "documents"), phrases))


def phrase_search_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase table that grows with the documents: the first four words of every one."""
    docs = sales.scan(spark, sf_dir, "documents")
    first = F.slice(F.split("text", " "), 1, 4)
    table = docs.select(F.when(F.size(first) == 4, F.array_join(first, " ")).alias("phrase")).filter("length(phrase) >= 16")
    return flat(phrases.phrase_search(docs, table))


QUERIES: dict[str, Query] = {
    "customer_360": _tables(customer360.customer_360),
    "customer_360_multi": _pooled(lambda t: customer360.customer_360(t, hot_rows=HOUSEHOLD_HOT)),
    "customer_360_bucketed": customer_360_bucketed,
    "customer_list": _tables(customer360.customer_list),
    "churn_band": _tables(lambda t: customer360.churn_bands(t["customer"])),
    "claim_summary": _tables(lambda t: customer360.claim_summary(t["claim"])),
    "latest_risk_per_property": _tables(lambda t: customer360.latest_risk(t["risk_history"])),
    "latest_interaction_per_customer": _tables(lambda t: customer360.latest_interaction(t["interaction"])),
    "renewal_flag": _tables(customer360.renewal_flag),
    "policy_pivot": _tables(lambda t: policy.policy_pivot(t["policy_version"])),
    "policy_comparison": _comparison(lambda c: c.drop("exclusions_added", "exclusions_removed")),
    "exclusion_diff": _comparison(exclusion_diff),
    "compare_policy_docs": _flat_policy_docs(_policy_docs),
    "compare_policy_docs_multi": _flat_policy_docs(_pooled_policy_docs),
    "key_findings": _exploded(_policy_docs, "doc.key_findings", "finding"),
    "renewal_report": _comparison(policy.renewal_report),
    "risk_change": _tables(risk.risk_change),
    "analyze_risk_docs": _flat_risk_docs(_risk_docs),
    "analyze_risk_docs_multi": _flat_risk_docs(_pooled_risk_docs),
    "causal_chain": _exploded(_risk_docs, "doc.causal_chain", "cause"),
    "communication_points": _exploded(_risk_docs, "doc.communication_points", "point"),
    "dialogue_turns": dialogue,
    "sentiment_score": _scores("sentiment", "sentiment_label"),
    "intent_label": _scores("intent"),
    "deep_signals": _scores(
        "urgency", "churn_signal", "pricing_concern", "coverage_concern", "complaint_signal",
        "recommended_tone", "customer_emotion",
    ),
    "retention_risk": _scores("retention_risk"),
    "document_signals": document_signals,
    "extractive_summary": extractive_summary,
    "key_phrases": key_phrases,
    "model_json_fallback": model_json_fallback,
    "recommendation_fallback": recommendation_fallback,
    "interaction_docs": interaction_docs,
    "text_search": text_search,
    "text_search_shuffled": lambda spark, sf_dir: text_search(spark, sf_dir, broadcast_rows=10),
    "text_search_topk": text_search_topk,
    "vector_search": vector_search,
    "vector_search_grid": lambda spark, sf_dir: vector_search(spark, sf_dir, broadcast_vectors=3, slices=2),
    "substring_search": substring_search,
    "vector_search_indexed": vector_search_indexed,
    "search_interactions": search_interactions,
    "vector_search_interactions": vector_search_interactions,
    "substring_requests": substring_requests,
    "phrase_search_large": phrase_search_large,
    "nba_context": nba_context,
    "nba_context_multi": nba_context_multi,
    "nba_prompts": nba_prompts,
    "nba_scores": nba_scores,
    "nba_ranked": nba_ranked,
    "nba_explanations": nba_explanations,
    "nba_documents": nba_documents,
    "action_log_append": action_log_append,
    "action_log_results": action_log_results,
    "action_log_batches": action_log_batches,
    "action_log_writers": action_log_writers,
    "tables_replaced": tables_replaced,
    "literal_customers": literal_customers,
    "customer_documents": customer_documents,
    "newest_actions": newest_actions,
    "default_requests": default_requests,
    "current_time": current_time,
    "applied_model": applied_model,
    "action_history": _tables(lambda t: actions.action_history(t["action_log"], t["customer"]).drop("recommended_action")),
    "action_history_top10": _tables(lambda t: actions.recent_actions(t["action_log"], t["customer"])),
    "action_outcomes": _tables(lambda t: actions.action_outcomes(t["action_log"])),
    "action_outcome_cube": _tables(lambda t: actions.outcome_cube(t["action_log"], t["interaction"])),
    "quality_report": quality_report,
    "fk_orphans": _tables(quality.fk_orphans),
    "fk_orphans_filtered": _tables(quality.fk_orphans_filtered),
    "stream_interactions": stream_interactions,
    "stream_postings": stream_postings,
    "stream_text_search": stream_text_search,
    "stream_risk_alerts": stream_risk_alerts,
    "stream_risk_alerts_state": stream_risk_alerts_state,
    "stream_hourly_status": stream_hourly_status,
    "stream_action_log": stream_action_log,
}
