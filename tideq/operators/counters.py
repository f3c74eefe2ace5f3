"""Daily and total counters as partial aggregates that are kept, merged with later batches and expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.functions.scalar import now_of
from tideq.operators import inspect

#: Days for which daily counters are kept.
DAYS = 90
PROCESSED, FAILED = ("completed", "retry", "archived"), ("retry", "archived")


def counted(outcomes: DataFrame, state: str = "state", at: str = "enqueued_at") -> DataFrame:
    """(queue, day, processed, failed) of rows (queue, state, at): a batch's part of the daily counters. Rows that are neither leave no day."""
    parts = outcomes.groupBy("queue", F.col(at).cast("date").alias("day")).agg(F.count_if(F.col(state).isin(*PROCESSED)).alias("processed"), F.count_if(F.col(state).isin(*FAILED)).alias("failed"))
    return parts.where("processed > 0")


def merged(*parts: DataFrame) -> DataFrame:
    """The sum of parts of the same kind: daily counters (queue, day, ...) or totals (queue, ...), in any order and grouping of the parts."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    key = [c for c in ("queue", "day") if c in both.columns]
    return both.groupBy(*key).agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))


def totals(daily: DataFrame) -> DataFrame:
    """(queue, processed, failed) over all days of ``daily``: taken before days expire, and merged with the totals so far."""
    return merged(daily.drop("day"))


def unexpired(daily: DataFrame, now: str | Column, days: int = DAYS) -> DataFrame:
    """Daily counters of the last ``days`` days, today included."""
    return daily.where(F.col("day") > F.date_sub(now_of(now).cast("date"), days))


def stats_in_full(tasks: DataFrame, daily: DataFrame, total: DataFrame, paused: DataFrame, now: str) -> DataFrame:
    """``queue_stats`` with paused, and processed and failed of today and in total, from kept counters; queues that hold no task but have counters or are paused count too."""
    queues = tasks.select("queue").unionByName(total.select("queue")).unionByName(paused.select("queue")).distinct()
    today = daily.where(F.col("day") == now_of(now).cast("date")).select("queue", F.col("processed").alias("processed_today"), F.col("failed").alias("failed_today"))
    ever = total.select("queue", F.col("processed").alias("processed_total"), F.col("failed").alias("failed_total"))
    current = inspect.queue_stats(tasks, now).drop("processed", "failed")
    out = queues.join(current, "queue", "left").join(today, "queue", "left").join(ever, "queue", "left").join(paused.select("queue", F.lit(True).alias("paused")).distinct(), "queue", "left")
    zero = [c for c in out.columns if c not in ("queue", "paused", "oldest_pending")]
    return out.select("queue", F.coalesce("paused", F.lit(False)).alias("paused"), "oldest_pending", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero))
