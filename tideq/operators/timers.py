"""What the clock does to tasks: release, expiry, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.functions.scalar import backoff_nanos, epoch, now_of

GRACE_SECONDS = 30
LEASE_ERROR = "task lease expired"


def forward(tasks: DataFrame, now: str) -> DataFrame:
    """Scheduled and retried tasks that are due, with new_state: into their group if they have one, else pending."""
    due = tasks.where(F.col("state").isin("scheduled", "retry") & (F.col("process_at") <= now_of(now)))
    return due.withColumn("new_state", F.when(F.col("group_key") != "", "aggregating").otherwise("pending"))


def expire_completed(tasks: DataFrame, now: str) -> DataFrame:
    """Completed tasks whose retention is over."""
    until = F.col("enqueued_at") + F.make_interval(secs=F.col("retention"))
    return tasks.where((F.col("state") == "completed") & (until <= now_of(now)))


def lease_expired(tasks: DataFrame, now: str) -> DataFrame:
    """Active tasks whose lease ended at least half a minute ago."""
    cutoff = now_of(now) - F.make_interval(secs=F.lit(GRACE_SECONDS))
    return tasks.where((F.col("state") == "active") & (F.col("lease_expires_at") <= cutoff))


def recover(tasks: DataFrame, now: str) -> DataFrame:
    """Tasks with expired leases, with new_state: archived if their retries are used up, else retry."""
    return lease_expired(tasks, now).withColumn("new_state", F.when(F.col("retried") >= F.col("retry"), "archived").otherwise("retry"))


def recover_fully(tasks: DataFrame, now: str, jitter: Column, is_failure: Column | None = None, delay: Column | None = None) -> DataFrame:
    """As ``recover``, with what the task holds afterwards: retry_at, retried, error and last_failed_at.

    An archived task isn't due again and keeps its count. ``delay`` (seconds)
    takes the place of the default backoff; a lost lease counts as a failure
    unless ``is_failure`` says otherwise, and only then as retried and as failed;
    otherwise the earlier ``last_failed_at`` stays, if ``tasks`` has one.
    """
    failure = F.lit(True) if is_failure is None else is_failure
    wait = F.call_function("div", backoff_nanos(F.col("retried"), jitter), F.lit(10**9)) if delay is None else delay
    again = F.col("new_state") == "retry"
    clock = epoch(now_of(now))
    return recover(tasks, now).withColumns(
        {
            "retry_at": F.when(again, clock + wait),
            "retried": F.when(again & failure, F.col("retried") + 1).otherwise(F.col("retried")),
            "error": F.lit(LEASE_ERROR),
            "last_failed_at": F.when(~again | failure, clock).otherwise(F.col("last_failed_at") if "last_failed_at" in tasks.columns else F.lit(None)),
        }
    )


def recovery(tasks: DataFrame, now: str, jitter: Column, kept: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All that recovery changes: the tasks to be tried again, the archives after their trim, and the day's counters of it.

    Archives are cut to tasks younger than 90 days and to the newest ``kept``, as whenever a task joins them; of queues that nothing
    joins, they stay as they are and aren't returned. Each recovered task counts as processed and failed.
    """
    from tideq.operators import admin, counters, lifecycle

    found = recover_fully(tasks, now, jitter)
    over = found.where("new_state = 'archived'").select(tasks.columns)
    old = tasks.where((F.col("state") == "archived") & (F.col("enqueued_at") > now_of(now) - F.make_interval(days=F.lit(lifecycle.ARCHIVE_DAYS))))
    touched = old.join(over.select("queue").distinct(), "queue", "left_semi").select(tasks.columns)
    archive = admin.joined_archive(touched, over, lifecycle.ARCHIVE_KEPT if kept is None else kept)
    counted = counters.counted(found.select("queue", "new_state").withColumn("at", now_of(now)), "new_state", "at")
    return found.where("new_state = 'retry'"), archive, counted


def recover_result(recovered: DataFrame) -> DataFrame:
    """queue, retried, archived, total of recovered tasks."""
    count = lambda state: F.count_if(F.col("new_state") == state)
    return recovered.groupBy("queue").agg(count("retry").alias("retried"), count("archived").alias("archived"), F.count("*").alias("total"))
