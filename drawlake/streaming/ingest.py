"""Running quantities over folders that drawings' tables arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 10, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def running_bill(items: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Quantities by key so far; the state is one row a key."""
    return items.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.round(F.sum(quantity), 4).alias("qty"))


def windowed_quantities(items: DataFrame, time: str, keys: list[str], quantity: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Quantities by time window and key; rows later than ``late`` are dropped, and state with them."""
    w = items.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n_rows"), F.round(F.sum(quantity), 4).alias("qty"))
    return w.select(F.col("w.start").alias("start"), *keys, "n_rows", "qty")


class FirstArrival(StatefulProcessor):
    """Passes a key's first row and remembers the key until it has been away for ``quiet_ms``; then a timer drops its state."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # all of it is read, but only its first row kept
            if first is None and len(part):
                first = part.head(1)
        known = self.due.exists()
        if known:
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.due.update((due,))
        self.handle.registerTimer(due)
        if not known and first is not None:
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_dedup(items: DataFrame, keys: list[str], time: str | None = None, within: str = "1 day", quiet_days: float | None = None) -> DataFrame:
    """The first arrival of each key: within a span of event time, or, with ``quiet_days``, until the key has not arrived for
    that long; both with bounded state. Without either, ever, with state for each key.

    ``quiet_days`` needs the RocksDB state store and a stream that goes on: its timers keep a query of all that is available now
    from ending.
    """
    if time is not None:
        return items.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    if quiet_days is not None:
        return items.groupBy(*keys).transformWithStateInPandas(FirstArrival(int(quiet_days * 86_400_000)), items.schema, "Append", "ProcessingTime")
    return items.dropDuplicates(keys)


def stream_bill(items: DataFrame, keys: list[str], quantity: str, checkpoint: str, out: str) -> StreamingQuery:
    """The running bill below ``out``: at each trigger the keys that it changed, with their quantities so far, written by
    the executors; a batch that is tried again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")

    return running_bill(items, keys, quantity).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_bill(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The running bill as it stands: of each key the row of the last version that changed it."""
    versions = spark.read.parquet(out)
    rest = [c for c in versions.columns if c not in (*keys, "version")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(*keys, "last.*")


def compact_bill(spark: SparkSession, out: str, keys: list[str]) -> None:
    """Folds all versions of a bill whose stream has ended into its last one, and drops the others."""
    versions = sorted(r[0] for r in spark.read.parquet(out).select("version").distinct().collect())
    if len(versions) < 2:
        return
    latest_bill(spark, out, keys).write.mode("overwrite").parquet(f"{out}/_folded")
    spark.read.parquet(f"{out}/_folded").write.mode("overwrite").parquet(f"{out}/version={versions[-1]}")
    jvm = spark._jvm.org.apache.hadoop.fs
    for old in (*(f"version={v}" for v in versions[:-1]), "_folded"):
        path = jvm.Path(f"{out}/{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def progress_sink(items: DataFrame, stage: str, out: str, checkpoint: str, key: str = "file_id") -> StreamingQuery:
    """A row (batch, stage, key, n_items, n_errors) of each key below ``out`` for each batch; rows that lack a key count as errors of
    key ''. A batch that is tried again overwrites its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count("*").alias("n_items"), F.count_if(F.col(key).isNull()).alias("n_errors"))
        rows.select(F.lit(stage).alias("stage"), key, "n_items", "n_errors").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
