"""What the stateful streams share. They keep typed state in RocksDB, which the session's state store has to be."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long state that no event has ended, or renewed, is kept.
IDLE_MS = 7 * 24 * 3600 * 1000


def with_typed_state(spark: SparkSession) -> SparkSession:
    """The session, whose streams from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def in_order(rows: Iterable, *keys: str) -> list:
    """A key's rows of one micro-batch by the columns named."""
    return sorted(rows, key=lambda r: tuple(r[k] for k in keys))


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "update", time: str = "ProcessingTime") -> DataFrame:
    return rows.groupBy(key).transformWithState(processor, schema, mode, time)
