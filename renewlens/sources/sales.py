"""The seven tables expressed over the sales, event and conversation tables.

The mapping lets every operator run at any volume on data that carries no
insurance columns. It keeps the shapes that matter: a customer has many orders
(policy versions), many events (risk assessments, interactions) and many line
items (claims), and any of them may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

POLICY_DAYS = 364

# Column types of the files, declared so that a scan needs no inference job.
COLUMNS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _cents(amount: Column) -> Column:
    """Whole cents as a long: sums are exact, so their order cannot matter."""
    return F.floor(amount * 100 + 0.5).cast("long")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return scan(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.col("c_name").alias("name"),
        (key % 60 + 20).cast("int").alias("age"),
        ((key % 120) / 10).cast("decimal(4,1)").alias("tenure_years"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("customer_value"),
        _pick(key % 4, "EXCELLENT", "GOOD", "FAIR", "POOR").alias("payment_history"),
        (key * 37 % 101 / 100).cast("decimal(3,2)").alias("churn_risk_score"),
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = scan(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    homes = scan(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return homes.join(nation, homes.c_nationkey == nation.n_nationkey, "left").select(
        key.alias("property_id"),
        key.alias("customer_id"),
        F.col("c_mktsegment").alias("property_type"),
        F.col("n_name").alias("location"),
        (key % 60).cast("int").alias("building_age"),
        _pick(key % 4, "WOOD_FRAME", "BRICK", "CONCRETE", "MIXED").alias("construction_type"),
    )


# Return flag and line status pairs, in the order in which they are listed.
LINE_CODES = ("AF", "AO", "NF", "NO", "RF", "RO")


def _order_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed per order before any join, so a huge order collapses map-side.

    All buffers are longs, the set of line codes included (one bit per code), which
    keeps the aggregation in generated hash code; a collected set would not.
    """
    codes = ", ".join(f"'{code}'" for code in LINE_CODES)
    position = f"array_position(array({codes}), concat(l_returnflag, l_linestatus))"
    price = _cents(F.col("l_extendedprice"))
    quantity = _cents(F.col("l_quantity"))
    returned = F.col("l_returnflag") == "R"
    listed = f"filter(array({codes}), (code, i) -> (codes & shiftleft(1L, i + 1)) != 0)"
    return (
        scan(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(
            F.sum(_cents(F.col("l_extendedprice") * F.col("l_tax"))).alias("deductible"),
            F.sum(price).alias("building"),
            F.sum(quantity).alias("contents"),
            F.sum(F.when(returned, price).otherwise(0)).alias("flood_cov"),
            F.sum(F.when(returned, quantity).otherwise(0)).alias("flood_ded"),
            F.coalesce(F.expr(f"bit_or(shiftleft(1L, cast({position} AS INT)))"), F.lit(0)).alias("codes"),
        )
        .withColumn("exclusions", F.expr(f"array_join({listed}, ', ')"))
        .drop("codes")
    )


def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest order of a customer is the RENEWAL, the one before it is CURRENT."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = (
        scan(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn <= 2")
    )
    lines = _order_measures(spark, sf_dir)
    effective = F.to_date("o_orderdate")
    expiry = F.date_add(effective, POLICY_DAYS)
    renewal = F.col("rn") == 1
    return orders.join(lines, orders.o_orderkey == lines.order_id, "left").select(
        F.col("o_custkey").alias("policy_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(renewal, "RENEWAL").otherwise("CURRENT").alias("policy_version"),
        F.col("o_orderpriority").alias("policy_type"),
        F.when(renewal, "PROPOSED")
        .when(F.col("o_orderstatus") == "F", "LAPSED")
        .otherwise("ACTIVE")
        .alias("policy_status"),
        effective.alias("effective_date"),
        expiry.alias("expiry_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("annual_premium"),
        _money(F.col("deductible")).alias("deductible"),
        _money(F.col("building")).alias("building_coverage"),
        _money(F.col("contents")).alias("contents_coverage"),
        _money(F.col("flood_cov")).alias("flood_coverage"),
        _money(F.col("flood_ded")).alias("flood_deductible"),
        "exclusions",
        expiry.alias("renewal_date"),
    )


def _band(value: Column, medium: int, high: int) -> Column:
    return F.when(value >= high, "HIGH").when(value >= medium, "MEDIUM").otherwise("LOW")


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_of_events(scan(spark, sf_dir, "events"))


def risk_of_events(events: DataFrame) -> DataFrame:
    """Row-local, so the same mapping serves batch and streaming scans."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("risk_assessment_id"),
        F.col("user_id").alias("property_id"),
        F.to_date("ts").alias("assessment_date"),
        _band(F.col("value"), 25, 75).alias("flood_risk"),
        _band(k, 34, 67).alias("fire_risk"),
        F.when(kind == "error", "HIGH")
        .when(kind.isin("purchase", "click"), "MEDIUM")
        .otherwise("LOW")
        .alias("earthquake_risk"),
        F.col("value").cast("decimal(12,2)").alias("overall_risk_score"),
        F.concat(kind, F.lit(" "), "props").alias("risk_reason"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items; the filter reaches the scan, and the join is inner so
    adaptive execution may split a huge order."""
    lines = scan(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"
    )
    orders = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.col("o_orderstatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_custkey").alias("policy_id"),
        _pick(F.col("l_partkey") % 5, "FLOOD", "FIRE", "THEFT", "LIABILITY", "OTHER").alias("claim_type"),
        F.when(status == "O", "OPEN").when(status == "F", "CLOSED").otherwise("DENIED").alias("claim_status"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("claim_amount"),
        F.to_date("l_shipdate").alias("claim_date"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return scan(spark, sf_dir, "events").select(
        F.col("event_id").alias("interaction_id"),
        F.col("user_id").alias("customer_id"),
        F.when(kind == "error", "CALL")
        .when(kind == "purchase", "EMAIL")
        .when(kind == "signup", "CHAT")
        .otherwise("NOTE")
        .alias("interaction_type"),
        F.col("ts").alias("interaction_timestamp"),
        F.col("props").alias("raw_transcript"),
        F.when(kind == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("agent_note"),
    )


ACTION_CODES = "ABCDEFG"


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged_events(scan(spark, sf_dir, "events"))


def logged_events(events: DataFrame) -> DataFrame:
    """Every event as one logged action; row-local, for batch and streaming scans."""
    code = F.substring(F.lit(ACTION_CODES), F.get_json_object("props", "$.k").cast("int") % 7 + 1, 1)
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("ACT-"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.col("event_id")).alias(
            "action_id"
        ),
        F.col("user_id").alias("customer_id"),
        F.col("event_id").alias("interaction_id"),
        F.to_json(F.struct(F.struct(code.alias("code")).alias("recommended_action"))).alias("recommended_action"),
        kind.alias("action_taken"),
        F.col("ts").alias("action_timestamp"),
        F.when(kind == "purchase", "EXECUTED")
        .when(kind == "error", "ESCALATED")
        .when(kind == "signup", "DECLINED")
        .otherwise("PENDING")
        .alias("status"),
    )


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customer": customers,
    "property": properties,
    "policy_version": policy_versions,
    "risk_history": risk_history,
    "claim": claims,
    "interaction": interactions,
    "action_log": action_log,
}


class SalesTables(Mapping[str, DataFrame]):
    """The seven tables by name, each defined when it is first asked for.

    Tables named in ``stored`` are written to the shared folder then, for
    products that read them several times: line items are summed once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: tuple[str, ...] = ()) -> None:
        self._spark, self._sf_dir, self._stored = spark, sf_dir, stored
        self._defined: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._defined:
            table = SOURCES[name](self._spark, self._sf_dir)
            self._defined[name] = written(table, name) if name in self._stored else table
        return self._defined[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SOURCES)

    def __len__(self) -> int:
        return len(SOURCES)


def sales_tables(spark: SparkSession, sf_dir: str, stored: tuple[str, ...] = ()) -> SalesTables:
    return SalesTables(spark, sf_dir, stored)


HOUSEHOLD = 3


def household_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same tables with homes and policies pooled: the first of every three customers
    holds those of all three, the others hold none."""
    pooled = F.col("customer_id") - (F.col("customer_id") - 1) % HOUSEHOLD
    tables = dict(sales_tables(spark, sf_dir, stored=("policy_version",)))
    for name in ("property", "policy_version"):
        tables[name] = tables[name].withColumn("customer_id", pooled)
    return tables


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dialogue turns. Turns stay separate rows: a conversation of
    any length is never gathered into one value."""
    return scan(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("interaction_id"),
        F.col("turn").alias("turn_no"),
        F.when(F.col("role") == "user", "Customer").otherwise("Agent").alias("speaker"),
        "text",
    )


def conversation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; the customer carries the same number."""
    return (
        scan(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("interaction_id"))
        .distinct()
        .select(
            "interaction_id",
            F.col("interaction_id").alias("customer_id"),
            F.lit("CHAT").alias("interaction_type"),
            F.lit(None).cast("timestamp_ntz").alias("interaction_timestamp"),
            F.lit(None).cast("string").alias("agent_note"),
        )
    )


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as single customer turns, for text operators at volume."""
    return scan(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("interaction_id"),
        F.lit(0).cast("long").alias("turn_no"),
        F.lit("Customer").alias("speaker"),
        "text",
    )
