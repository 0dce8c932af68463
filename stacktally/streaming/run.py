"""Running a stream over the files that are there and then stopping."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the RocksDB state store, which keyed state with timers needs.

    A query keeps the settings it was started with, so the session gets its own back.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in at most two partitions a core.

    Each partition costs a state store, and with keyed state a Python worker, in every batch, however
    few rows it gets. A checkpoint remembers the number that it began with.
    """
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def drain(writer: DataStreamWriter, checkpoint: str, keyed: bool = False, stateful: bool = False) -> StreamingQuery:
    """Processes everything available; the next call goes on from the checkpoint.

    ``stateful`` queries get their ``state_partitions``.
    """
    spark = SparkSession.active()
    with keyed_state(spark) if keyed else nullcontext(), state_partitions(spark) if stateful else nullcontext():
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(rows: DataFrame, path: str) -> DataStreamWriter:
    """Append to parquet files, exactly once."""
    return rows.writeStream.format("parquet").option("path", path).outputMode("append")
