"""Data quality as one product: (test_id, result, details) rows.

Every check reduces its input to one row before rows are combined; keys are
counted with map-side combine before they are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS
from ..sources.tables import Tables
from .customer360 import customer_360
from .policy import policy_comparison
from .risk import risk_change

CORE_FIELDS = ("tenure_years", "payment_history", "location", "policy_id", "current_flood_risk")
# Least scenario counts for good coverage.
LEAST_CHURN_LABELS = 3
LEAST_CUSTOMERS = 4


def _row(test_id: str, passed: Column, **details: Column | str) -> Column:
    """One report row over a one-row frame; ``details`` become name=value text."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")))
        for name, v in details.items()
    ]
    return F.struct(
        F.lit(test_id).alias("test_id"),
        F.when(passed, "PASS").otherwise("FAIL").alias("result"),
        F.concat_ws(", ", *parts).alias("details"),
    )


def _report(counted: DataFrame, *rows: Column) -> DataFrame:
    """All report rows of one aggregate, so that its input is read once."""
    return counted.select(F.inline(F.array(*rows)))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_checks(
    tables: Tables,
    expected: dict[str, int] | None = None,
    allowed: dict[str, dict[str, tuple[str, ...]]] = DOMAINS,
    longest: dict[str, dict[str, int]] = MAX_LENGTHS,
) -> DataFrame:
    """Row count, value domains and text lengths of every table, from one aggregate per table.

    Without an expectation a table only has to hold rows; NULL is in every domain and fits every length.
    """
    reports = []
    for name, df in tables.items():
        codes, limits = allowed.get(name, {}), longest.get(name, {})
        counted = df.agg(
            F.count("*").alias("n"),
            *[F.count_if(~F.col(c).isin(*values)).alias(f"outside_{c}") for c, values in codes.items()],
            *[F.count_if(F.length(F.col(c).cast("string")) > n).alias(f"long_{c}") for c, n in limits.items()],
        )
        wanted = (expected or {}).get(name)
        rows = [_row(f"row_count:{name}", F.col("n") > 0 if wanted is None else F.col("n") == wanted, rows="n")]
        rows += [_row(f"domain:{name}.{c}", F.col(f"outside_{c}") == 0, outside=f"outside_{c}") for c in codes]
        if limits:
            fits = reduce(Column.__and__, [F.col(f"long_{c}") == 0 for c in limits])
            rows.append(_row(f"length:{name}", fits, **{c: f"long_{c}" for c in limits}))
        reports.append(_report(counted, *rows))
    return _union(reports)


def customer_checks(c360: DataFrame, expected: int | None = None) -> DataFrame:
    """Completeness of the core fields and coverage of the scenarios, in one pass."""
    gap = reduce(Column.__or__, [F.col(c).isNull() for c in CORE_FIELDS])
    claims = F.col("total_claims")
    counted = c360.agg(
        F.count("*").alias("n"),
        F.count_if(gap).alias("incomplete"),
        F.count_distinct("churn_risk_label").alias("labels"),
        F.count_if("has_renewal_proposal").alias("with_renewal"),
        F.count_if(claims > 0).alias("with_claims"),
        F.count_if(claims == 0).alias("without_claims"),
        F.count_if(F.col("policy_status") == "LAPSED").alias("lapsed"),
    )
    complete = (F.col("incomplete") == 0) & (F.lit(True) if expected is None else F.col("n") == expected)
    enough = [F.col(c) >= LEAST_CUSTOMERS for c in ("with_renewal", "with_claims", "without_claims")]
    covered = reduce(Column.__and__, enough, F.col("labels") >= LEAST_CHURN_LABELS)
    return _report(
        counted,
        _row(
            "customer_360_completeness", complete,
            customers="n", incomplete="incomplete", with_renewal="with_renewal",
        ),
        _row(
            "scenario_coverage", covered, churn_labels="labels", with_renewal="with_renewal",
            with_claims="with_claims", without_claims="without_claims", lapsed="lapsed",
        ),
    )


def comparison_range(comparison: DataFrame, expected: int | None = None) -> DataFrame:
    pct = F.col("premium_change_pct")
    counted = comparison.agg(
        F.count("*").alias("n"), F.count_if(pct.isNull()).alias("unknown"),
        F.min(pct).alias("lowest"), F.max(pct).alias("highest"),
    )
    passed = (F.col("unknown") == 0) & (F.lit(True) if expected is None else F.col("n") == expected)
    return _report(
        counted,
        _row(
            "policy_comparison_range", passed,
            renewals="n", without_percent="unknown", lowest="lowest", highest="highest",
        ),
    )


def expected_values(df: DataFrame, test_id: str, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` whose values ``df`` does not carry, NULLs included."""
    values = [c for c in expected.columns if c not in keys]
    wanted = expected.select(*keys, F.struct(*values).alias("wanted"))
    actual = df.select(*keys, F.struct(*[F.col(c).cast(expected.schema[c].dataType) for c in values]).alias("actual"))
    compared = wanted.join(actual, keys, "left")
    counted = compared.agg(
        F.count("*").alias("n"), F.count_if(~F.col("wanted").eqNullSafe(F.col("actual"))).alias("different")
    )
    passed = (F.col("n") > 0) & (F.col("different") == 0)
    return _report(counted, _row(test_id, passed, rows="n", different="different"))


def risk_directions(changes: DataFrame, expected: int | None = None, directions: DataFrame | None = None) -> DataFrame:
    """Counts of rising risks. With ``directions`` (customer_id, dimension, direction) rows the
    check only passes if every listed customer has a change in that direction."""
    up = {d: F.count_if(F.col(f"{d}_direction") == "UP").alias(f"{d}_up") for d in ("flood", "fire", "earthquake")}
    counted = changes.agg(F.count("*").alias("n"), *up.values())
    passed = F.col("n") > 0 if expected is None else F.col("n") == expected
    details = {"changes": "n", "flood_up": "flood_up", "fire_up": "fire_up", "earthquake_up": "earthquake_up"}
    if directions is not None:
        found = changes.select(
            "customer_id",
            F.explode(F.map_from_arrays(F.array(*map(F.lit, up)), F.array(*[f"{d}_direction" for d in up]))).alias("dimension", "direction"),
        ).distinct()
        missing = directions.join(found, ["customer_id", "dimension", "direction"], "left_anti").agg(F.count("*").alias("missing"))
        counted = counted.withColumn("missing", missing.scalar())
        passed, details = passed & (F.col("missing") == 0), details | {"missing": "missing"}
    return _report(counted, _row("risk_change_directions", passed, **details))


def fk_orphans(tables: Tables) -> DataFrame:
    """(child, child_column, orphans) per foreign key.

    Children are counted per key first, so a key with very many children costs
    one row in the anti join.
    """
    return _union([_orphans(tables, *link) for link in FOREIGN_KEYS])


def _orphans(tables: Tables, child: str, column: str, parent: str, parent_column: str) -> DataFrame:
    counted = tables[child].groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    parents = tables[parent].select(F.col(parent_column).alias("key"))
    orphans = counted.join(parents, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
    return orphans.select(F.lit(child).alias("child"), F.lit(column).alias("child_column"), "orphans")


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Packed keys (64 of neighbouring numbers a row) that may be sent to every task.
BROADCAST_SLOTS = 1_000_000


def packed_keys(parents: DataFrame, column: str) -> DataFrame:
    """(slot, mask): the whole-number keys of ``parents`` as bits, one row per 64 neighbouring numbers."""
    key = F.col(column).cast("long")
    slots = parents.select(F.shiftright(key, 6).alias("slot"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("bit"))
    return slots.filter("slot IS NOT NULL").groupBy("slot").agg(F.bit_or("bit").alias("mask"))


def fk_orphans_filtered(tables: Tables, slots: int = BROADCAST_SLOTS) -> DataFrame:
    """The rows of ``fk_orphans``, without an exchange of the children where parents have whole-number keys.

    The keys of the parents are packed into bits, 64 to a row if they are dense, and sent to the
    children: a bit says exactly whether a parent is there. (A Bloom filter would not do: what it lets through still has
    to meet the parents.) Keys of other types, and those too sparse for ``slots`` rows, are compared as in ``fk_orphans``.
    """
    rows = []
    for link in FOREIGN_KEYS:
        child, column, parent, parent_column = link
        kinds = tables[child].schema[column].dataType, tables[parent].schema[parent_column].dataType
        held = packed_keys(tables[parent], parent_column) if all(isinstance(k, INTEGERS) for k in kinds) else None
        if held is None or held.limit(slots + 1).count() > slots:
            rows.append(_orphans(tables, *link))
            continue
        key = F.col(column).cast("long")
        children = tables[child].select(F.shiftright(key, 6).alias("slot"), key.bitwiseAND(F.lit(63)).cast("int").alias("place"))
        met = children.join(F.broadcast(held), "slot", "left")
        missing = F.coalesce(F.expr("shiftrightunsigned(mask, place) & 1") == 0, F.lit(True))
        rows.append(met.agg(F.count_if(missing).alias("orphans")).select(F.lit(child).alias("child"), F.lit(column).alias("child_column"), "orphans"))
    return _union(rows)


def integrity(tables: Tables) -> DataFrame:
    return fk_orphans(tables).select(
        F.concat(F.lit("foreign_key:"), "child", F.lit("."), "child_column").alias("test_id"),
        F.when(F.col("orphans") == 0, "PASS").otherwise("FAIL").alias("result"),
        F.concat(F.lit("orphans="), F.col("orphans").cast("string")).alias("details"),
    )


def unique_keys(tables: Tables) -> DataFrame:
    """Primary keys that occur more than once or hold NULL."""
    rows = []
    for name, keys in PRIMARY_KEYS.items():
        if name not in tables:
            continue
        per_key = tables[name].groupBy(*keys).agg(F.count("*").alias("n"))
        unset = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
        counted = per_key.agg(F.count_if((F.col("n") > 1) | unset).alias("bad"))
        rows.append(_report(counted, _row(f"primary_key:{name}", F.col("bad") == 0, bad_keys="bad")))
    return _union(rows)


def quality_report(
    tables: Tables,
    expected_rows: dict[str, int] | None = None,
    expected_comparisons: int | None = None,
    expected_changes: int | None = None,
    allowed: dict[str, dict[str, tuple[str, ...]]] = DOMAINS,
    comparison_values: DataFrame | None = None,
    change_values: DataFrame | None = None,
    directions: DataFrame | None = None,
) -> DataFrame:
    """All checks as (test_id, result, details).

    ``comparison_values`` and ``change_values`` are expected rows by
    ``customer_id`` with any columns of the two products; ``directions`` lists
    risks that must have moved (see ``risk_directions``).
    """
    comparison, changes = policy_comparison(tables), risk_change(tables)
    parts = [
        table_checks(tables, expected_rows, allowed),
        customer_checks(customer_360(tables, hot_rows=None), (expected_rows or {}).get("customer")),
        comparison_range(comparison, expected_comparisons),
        risk_directions(changes, expected_changes, directions),
        integrity(tables),
        unique_keys(tables),
    ]
    if comparison_values is not None:
        parts.append(expected_values(comparison, "policy_comparison_values", comparison_values, ["customer_id"]))
    if change_values is not None:
        parts.append(expected_values(changes, "risk_change_values", change_values, ["customer_id"]))
    return _union(parts)
