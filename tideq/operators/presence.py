"""Servers, workers and schedulers that report themselves, and cancellations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(reports: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last report of each key: a later one takes the place of all before."""
    rest = [c for c in reports.columns if c not in key]
    return reports.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*key, "r.*")


def live(reports: DataFrame, now: Column) -> DataFrame:
    return reports.where(F.col("expires_at") >= now)


def without(rows: DataFrame, cleared: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` but for those of the cleared keys."""
    return rows.join(cleared.select(*key).distinct(), key, "left_anti")


def entries(schedulers: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The rows (scheduler_id, entry_id, prev_at) of live schedulers (scheduler_id, expires_at); times that never were are null."""
    listed = rows.join(live(schedulers, now).select("scheduler_id").distinct(), "scheduler_id", "left_semi")
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return listed.withColumn("prev_at", F.when(F.col("prev_at") != never, F.col("prev_at")))


def cancelled(active: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Active tasks for which a cancellation (id, at) came after they began (started_at)."""
    first = cancellations.groupBy("id").agg(F.max("at").alias("at"))
    return active.join(first, "id").where(F.col("at") >= F.col("started_at")).drop("at")
