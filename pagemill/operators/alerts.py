"""Cooldowns, budgets, harvests and label guards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cooldown(events: DataFrame, by: list[str], ts: str, order: str, minutes: int = 60) -> DataFrame:
    """Events that are emitted: none within so many minutes of the last emitted one of its key.

    A fold in time order: rows are sorted by key and time in their partitions and stream past, with the last emitted time as all that is kept.
    """
    kept = [*by, ts, order]
    span = np.timedelta64(minutes, "m")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in parts:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True))
            times = batch.column(len(by)).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            for i, (k, t) in enumerate(zip(keys, times, strict=True)):
                if k != key:
                    key, last = k, None
                if last is None or t - last >= span:
                    keep[i], last = True, t
            yield batch.filter(pa.array(keep))

    rows = events.select(*kept)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, ts, order).mapInArrow(run, rows.schema)


def running_cost(events: DataFrame, ts: str, order: str, cost: str, unit: str) -> DataFrame:
    """events with spent: the running cost of its day or month. Hours are summed apart, and what the hours before them cost is added."""
    whole, hour = F.date_trunc(unit, ts), F.date_trunc("hour", ts)
    inside = events.withColumns({"_unit": whole, "_hour": hour}).withColumn("spent", F.sum(cost).over(Window.partitionBy("_unit", "_hour").orderBy(ts, order)))
    before = Window.partitionBy("_unit").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # 744 hours at most
    totals = events.groupBy(whole.alias("_unit"), hour.alias("_hour")).agg(F.sum(cost).alias("_total"))
    totals = totals.select("_unit", "_hour", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_before"))
    return inside.join(totals, ["_unit", "_hour"]).withColumn("spent", F.col("spent") + F.col("_before")).drop("_unit", "_hour", "_before")


def budget_state(spent: Column, limit: float, warn: float = 0.8) -> Column:
    return F.when(spent >= limit, "blocked").when(spent >= limit * warn, "warning").otherwise("ok")


def harvest_reason(entropy: Column, agreement: Column, escalated: Column, score: Column) -> Column:
    """First reason that holds, null without one."""
    return F.when(entropy >= 0.7, "high_entropy").when(agreement <= 0.5, "low_agreement").when(escalated, "escalated").when((score < 0.1) | (score > 0.9), "outlier")


#: Fixed words of the privacy check.
PII = ("ssn", "social_security", "passport", "driver_license", "credit_card", "bank_account", "medical_record", "health_record", "personal_id", "national_id")
PATHS = ("personal", "private", "confidential", "pii", "hipaa")


def privacy(path: Column, metadata: Column) -> Column:
    return F.when(F.lower(path).rlike("|".join(PATHS)), "path").when(F.lower(metadata).rlike("|".join(PII)), "metadata").otherwise("clear")


def guard_labels(df: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """df with guarded: the first `most` values by first appearance stay, others become overflow."""
    seen = df.groupBy(label).agg(F.min(F.struct(*order)).alias("first"))
    top = seen.orderBy("first").limit(most).select(label, F.lit(True).alias("_in"))
    return df.join(F.broadcast(top), label, "left").withColumn("guarded", F.when(F.col("_in"), F.col(label)).otherwise("overflow")).drop("_in")  # at most `most` rows
