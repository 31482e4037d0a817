"""Structured Streaming over the event stream: windowed rates, sessions, deduplication, cooldown with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream, timestamps in UTC."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finish(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there into a table of files in the shared folder, and give that table. Nothing comes to the driver.

    Each batch is written under its number, so one that runs again replaces itself; in complete mode the last one is the result.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/{name}"
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/progress").outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        last = q.lastProgress
    finally:
        q.stop()
    if last is None:
        return spark.createDataFrame([], schema)
    which = f"batch={last['batchId']}" if mode == "complete" else "batch=*"
    return spark.read.schema(schema).parquet(f"{out}/rows/{which}")


def window_rates(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def cooldown(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Emitted events of each type: the state of a key is the time of its last emitted event."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        keep = []
        for t in rows["ts"]:
            us = int(t.value // 1000)
            ok = last is None or us - last >= minutes * 60_000_000
            keep.append(ok)
            last = us if ok else last
        if last is not None:
            state.update((last,))
        yield rows[keep][["event_type", "event_id", "ts"]]

    rows = events.select("event_type", "event_id", "ts")
    return rows.groupBy("event_type").applyInPandasWithState(fold, "event_type string, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)
