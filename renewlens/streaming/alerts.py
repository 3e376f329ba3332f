"""Risk alerts from keyed state: every property keeps its newest two assessments in a state store.

A micro-batch touches the state of the properties it brings and nothing else, so
its cost does not grow with what came before. The state lies in RocksDB and is
checkpointed by its changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.risk import assessment_pairs, directions
from .feeds import _batch_folder, _start

ID, KEY, DATE = "risk_assessment_id", "property_id", "assessment_date"
#: Assessments of a property that are looked at together.
HELD = 1_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class NewestTwo(StatefulProcessor):
    """Keeps the newest two assessments of a property and hands them on, ranked, whenever they change.

    Equal dates go by the larger id, missing dates come last. An assessment that is delivered again, and one that is
    older than both, changes nothing and gives no row.
    """

    def __init__(self, schema: T.StructType) -> None:
        self.schema, self.names = schema, schema.names
        self.id, self.date = self.names.index(ID), self.names.index(DATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("newest", self.schema)

    def _rank(self, row: tuple) -> tuple:
        return row[self.date] is not None, row[self.date] or 0, row[self.id]

    def _newest(self, rows: dict) -> dict:
        return {r[self.id]: r for r in sorted(rows.values(), key=self._rank, reverse=True)[:2]}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {r[self.id]: r for r in map(tuple, self.kept.get())}
        found = before
        for some in batched(rows, HELD):  # as many as there are: few assessments are held
            given = [tuple(row[name] for name in self.names) for row in some]
            found = self._newest({r[self.id]: r for r in given} | found)
        if found != before:
            self.kept.put(list(found.values()))
            if len(found) == 2:
                ranked = Row(*self.names, "rn")
                yield from (ranked(*r, n) for n, r in enumerate(found.values(), 1))

    def close(self) -> None:
        pass


def _newest_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per property of each Arrow batch, so that a property with very many assessments sends few to its state."""
    for batch in batches:
        order = pc.sort_indices(batch, sort_keys=[(DATE, "ascending"), (ID, "ascending")], null_placement="at_start").to_numpy()
        key, name = (batch.column(c).dictionary_encode().indices.to_numpy()[order].astype("int64") for c in (KEY, ID))
        first = np.sort(np.unique(key * (len(batch) + 1) + name, return_index=True)[1])  # one row per assessment
        by_key = first[np.argsort(key[first], kind="stable")]
        last = np.searchsorted(key[by_key], key[by_key], side="right")
        yield batch.take(pa.array(order[by_key[last - np.arange(len(by_key)) <= 2]]))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a query that is started inside; those of the session come back afterwards."""
    old = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def risk_alert_state_feed(assessments: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Risk changes as assessments arrive, one row per property that changed in a batch; read them with ``latest_alerts``.

    The result does not depend on the order of arrival. Rows without a property or an id are left out. The columns
    of ``assessments`` are those of the ``risk_history`` table.
    """
    spark, schema = assessments.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in assessments.schema.fields])
    given = assessments.filter(f"{KEY} IS NOT NULL AND {ID} IS NOT NULL").mapInArrow(_newest_of_batch, schema)
    ranked = given.groupBy(KEY).transformWithState(
        NewestTwo(schema), T.StructType([*schema.fields, T.StructField("rn", T.IntegerType())]), outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = assessment_pairs(batch).select("*", *directions(), F.lit(batch_id).alias("seen_in"))
        changed.write.mode("overwrite").parquet(_batch_folder(f"{out}/changes", batch_id))

    with _settings(spark, STATE_STORE):
        return _start(ranked.writeStream.outputMode("update").foreachBatch(write), checkpoint, every)
