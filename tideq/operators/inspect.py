"""Queries over the task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideq.functions.scalar import STATES, epoch, now_of

PAGE_SIZE = 30


def queue_stats(tasks: DataFrame, now: str) -> DataFrame:
    """Counts by state, groups and latency of each queue."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return (
        tasks.groupBy("queue")
        .agg(
            F.count("*").alias("size"), *counts, F.countDistinct(F.when(F.col("state") == "aggregating", F.col("group_key"))).alias("groups"),
            F.count_if(F.col("state").isin("completed", "retry", "archived")).alias("processed"),
            F.count_if(F.col("state").isin("retry", "archived")).alias("failed"),
            F.min_by("enqueued_at", F.when(F.col("state") == "pending", F.col("pos"))).alias("oldest_pending"),
        )
        .withColumn("latency", F.coalesce(F.greatest(epoch(now_of(now)) - epoch(F.col("oldest_pending")), F.lit(0)), F.lit(0)))
    )


def history(tasks: DataFrame, now: str, days: int) -> DataFrame:
    """Processed and failed tasks of each queue on each of the last ``days`` UTC days, zeros included."""
    if days < 1:
        raise ValueError("days must be at least 1")
    last = now_of(now).cast("date")
    calendar = tasks.select("queue").distinct().select("queue", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counted = tasks.groupBy("queue", F.col("enqueued_at").cast("date").alias("day")).agg(
        F.count_if(F.col("state").isin("completed", "retry", "archived")).alias("processed"), F.count_if(F.col("state").isin("retry", "archived")).alias("failed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(counted, ["queue", "day"], "left").select("queue", "day", zero("processed"), zero("failed"))


def group_sizes(tasks: DataFrame) -> DataFrame:
    return tasks.where("state = 'aggregating'").groupBy("queue", "group_key").agg(F.count("*").alias("size"))


def memory_estimate(tasks: DataFrame, sample: int = 20) -> DataFrame:
    """Bytes of payload of each queue: the mean of the first ``sample`` of each state, times its count."""
    first = Window.partitionBy("queue", "state").orderBy("pos", "id")
    few = tasks.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= sample)
    means = few.groupBy("queue", "state").agg((F.sum(F.octet_length("payload")).cast("double") / F.count("*")).alias("mean"))
    counts = tasks.groupBy("queue", "state").agg(F.count("*").alias("n"))
    return counts.join(means, ["queue", "state"]).groupBy("queue").agg(F.sum(F.floor(F.col("mean") * F.col("n")).cast("bigint")).alias("bytes"))


def next_process_at(now: str) -> Column:
    """When a task is next due: its time if it waits for one, now if it is pending, else null."""
    return F.when(F.col("state").isin("scheduled", "retry"), F.col("process_at")).when(F.col("state") == "pending", now_of(now))


def list_tasks(tasks: DataFrame, state: str, page: int = 1, size: int = PAGE_SIZE, group: str | None = None) -> DataFrame:
    """One page of the tasks of a state in each queue: pending and active by position, others by time and id."""
    if page < 1 or size < 0:
        raise ValueError("pages count from 1, sizes from 0")
    chosen = tasks.where(F.col("state") == state)
    if group is not None:
        chosen = chosen.where(F.col("group_key") == group)
    by = {"pending": ["pos"], "active": ["pos"], "scheduled": ["process_at"], "retry": ["process_at"]}.get(state, ["enqueued_at"])
    order = Window.partitionBy("queue").orderBy(*by, F.col("id").cast("binary"))
    return chosen.withColumn("rn", F.row_number().over(order)).where((F.col("rn") > (page - 1) * size) & (F.col("rn") <= page * size))


def orphaned(now: str) -> Column:
    """Whether an active task's lease ended half a minute ago or before."""
    return F.col("lease_expires_at") <= now_of(now) - F.make_interval(secs=F.lit(30))


def task_info(tasks: DataFrame, queue: str, ids: list[str], now: str) -> DataFrame:
    found = tasks.where((F.col("queue") == queue) & F.col("id").isin(*ids))
    return found.select("queue", "id", "type", "state", "retry", "retried", next_process_at(now).alias("next_process_at"))


def servers_with_workers(servers: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """Live servers, each with an array of its workers."""
    live = servers.where(F.col("expires_at") >= now)
    by_server = workers.where(F.col("expires_at") >= now).groupBy("server_id").agg(F.array_sort(F.collect_list(F.struct("task_id", "task_type"))).alias("active_workers"))
    empty = F.array().cast("array<struct<task_id:bigint,task_type:string>>")
    return live.join(by_server, "server_id", "left").withColumn("active_workers", F.coalesce("active_workers", empty))


def scheduler_events(events: DataFrame, page: int, size: int, kept: int = 1_000) -> DataFrame:
    """A page of each entry's enqueue events, newest first, of the newest ``kept``."""
    order = Window.partitionBy("entry_id").orderBy(F.desc("enqueued_at"), F.desc("task_id"))
    ranked = events.withColumn("rn", F.row_number().over(order))
    return ranked.where((F.col("rn") <= kept) & (F.col("rn") > (page - 1) * size) & (F.col("rn") <= page * size))
