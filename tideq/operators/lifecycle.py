"""Outcomes of tasks: state transitions as projections over the task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideq.functions.scalar import backoff_nanos, epoch, is_blank, now_of
from tideq.operators.running import numbered

LEASE_SECONDS = 30
DEFAULT_TIMEOUT_SECONDS = 1800
ARCHIVE_DAYS = 90
#: A cap of 10,000 trims before it adds, so one fewer stays.
ARCHIVE_KEPT = 9_999


def dequeue(tasks: DataFrame, paused: DataFrame | None, now: str, order: DataFrame | None = None) -> DataFrame:
    """The oldest pending task of each queue that isn't paused, leased; or of the first queue in ``order`` (queue, rank) only."""
    open_ = tasks.where("state = 'pending'")
    if paused is not None:
        open_ = open_.join(paused.select("queue").distinct(), "queue", "left_anti")
    first = open_.groupBy("queue").agg(F.min_by(F.struct(*tasks.columns), F.struct("pos", "id")).alias("t"))
    taken = first.select("t.*")
    if order is not None:
        taken = taken.join(order, "queue").orderBy("rank").limit(1).drop("rank")
    return taken.withColumn("state", F.lit("active")).withColumn("lease_expires_at", now_of(now) + F.make_interval(secs=F.lit(LEASE_SECONDS)))


def _named(priorities: DataFrame) -> DataFrame:
    """Queues (queue, priority) that are named and have a priority above 0; the queue ``default`` if none has."""
    fine = priorities.where(~is_blank(F.col("queue")) & (F.col("priority") > 0)).select("queue", F.col("priority").cast("long").alias("priority"))
    none = fine.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("default").alias("queue"), F.lit(1).cast("long").alias("priority"))
    return fine.unionByName(none)


def strict_order(priorities: DataFrame) -> DataFrame:
    """(queue, rank) by priority, highest first; names and priorities that don't count are left out."""
    return _named(priorities).select("queue", F.row_number().over(Window.orderBy(F.desc("priority"), "queue")).alias("rank"))


def weighted_order(priorities: DataFrame, seed: int | None = None) -> DataFrame:
    """(queue, rank): a random order in which each place falls to a queue by its priority.

    The smallest of p uniform draws is one draw u as 1 - (1 - u)^(1 / p).
    """
    drawn = _named(priorities).withColumn("draw", 1 - F.pow(1 - F.rand(seed), 1 / F.col("priority")))
    return drawn.select("queue", F.row_number().over(Window.orderBy("draw", "queue")).alias("rank"))


def deadline(timeout: Column, limit: Column, now: str) -> Column:
    """When a task must end: the earlier of now + timeout and its own limit; half an hour if it has neither (zero)."""
    clock = epoch(now_of(now))
    return (
        F.when((timeout > 0) & (limit > 0), F.least(clock + timeout, limit))
        .when(timeout > 0, clock + timeout)
        .when(limit > 0, limit)
        .otherwise(clock + DEFAULT_TIMEOUT_SECONDS)
    )


def outcome(error: Column, retried: Column, retry: Column, retention: Column, lease: Column, now: str) -> Column:
    """What happens to a task after its handler: the order of the checks matters. A lease that ends just now still holds."""
    return (
        F.when(lease < now_of(now), "lease_expired")
        .when(error.isNull(), F.when(retention > 0, "completed").otherwise("done"))
        .when(error == "revoke", "done")
        .when((error == "skip_retry") | (retried >= retry), "archived")
        .otherwise("retry")
    )


def complete(tasks: DataFrame, now: str) -> DataFrame:
    """Active tasks that succeeded: completed until their retention ends, or gone if they have none."""
    ended = tasks.where("state = 'active'")
    kept = ended.where("retention > 0").withColumn("expires_at", epoch(now_of(now)) + F.col("retention"))
    return kept.withColumn("state", F.lit("completed"))


def done(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the active tasks named in ``ids`` (queue, id)."""
    gone = tasks.where("state = 'active'").join(ids.select("queue", "id").distinct(), ["queue", "id"], "left_semi").select("queue", "id")
    return tasks.join(gone, ["queue", "id"], "left_anti")


def retry(tasks: DataFrame, now: str, is_failure: Column, jitter: Column, delay: Column | None = None) -> DataFrame:
    """Active tasks that failed: due again after the backoff, or after ``delay`` (seconds); only failures count as retried."""
    delay = F.floor(backoff_nanos(F.col("retried"), jitter) / 1_000_000_000) if delay is None else delay
    return (
        tasks.where("state = 'active'")
        .withColumn("retry_at", epoch(now_of(now)) + delay)
        .withColumn("retried", F.when(is_failure, F.col("retried") + 1).otherwise(F.col("retried")))
        .withColumn("state", F.lit("retry"))
    )


def archive_trim(tasks: DataFrame, now: str, kept: int = ARCHIVE_KEPT, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Archived tasks that stay: those young enough, and of them the newest of each queue."""
    young = tasks.where((F.col("state") == "archived") & (F.col("enqueued_at") > now_of(now) - F.make_interval(days=F.lit(days))))
    return newest(young, kept)


def newest(archived: DataFrame, kept: int, first: str | None = None) -> DataFrame:
    """The newest ``kept`` rows of each queue, those with the greater ``first`` (0 or 1) before others; counted in slices of time, as an archive may be of any size."""
    # a time of none comes last, behind all that fit the calendar
    at = F.coalesce(F.unix_micros(F.col("enqueued_at").cast("timestamp")), F.lit(-4 * 10**17))
    order = [F.desc(c) for c in ("enqueued_at", "id")]
    if first is not None:
        at, order = at + F.col(first) * F.lit(10**18), [F.desc(first), *order]
    return numbered(archived, ["queue"], -at, order, "rn").where(F.col("rn") <= kept).drop("rn")


def requeue(tasks: DataFrame) -> DataFrame:
    """Active tasks put back before all pending ones of their queue, the last one put back first."""
    front = tasks.where("state = 'pending'").groupBy("queue").agg(F.min("pos").alias("front"))
    active = numbered(tasks.where("state = 'active'"), ["queue"], F.col("pos"), ["pos", "id"], "n")
    return active.join(front, "queue", "left").withColumn("pos", F.coalesce("front", F.lit(0)) - F.col("n")).withColumn("state", F.lit("pending")).drop("n", "front")


def extend_leases(tasks: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Active tasks named in ``ids`` (queue, id) that have a lease, run out or not, leased anew."""
    leased = tasks.where((F.col("state") == "active") & F.col("lease_expires_at").isNotNull())
    named = leased.join(ids.select("queue", "id").distinct(), ["queue", "id"], "left_semi")
    return named.withColumn("lease_expires_at", now_of(now) + F.make_interval(secs=F.lit(LEASE_SECONDS)))


def run_summary(transitions: DataFrame) -> DataFrame:
    """Counts of outcomes by queue."""
    return transitions.groupBy("queue", "outcome").agg(F.count("*").alias("n"))


def run_summary_in_full(transitions: DataFrame, forwarded: DataFrame, recovered: DataFrame, expired: DataFrame) -> DataFrame:
    """One row of counts a queue: what became of the tasks run (queue, outcome), and what forwarding, recovery (queue, new_state) and expiry (queue) did."""
    ended = {"completed": "completed", "done": "done", "retried": "retry", "lease_expired": "lease_expired", "archived": "archived"}
    parts = [transitions.select("queue", F.concat(F.lit("run:"), "outcome").alias("what")), forwarded.select("queue", F.concat(F.lit("forwarded:"), "new_state").alias("what"))]
    parts += [recovered.select("queue", F.concat(F.lit("recovered:"), "new_state").alias("what")), expired.select("queue", F.lit("expired").alias("what"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    count = lambda what: F.count_if(F.col("what") == what)
    return every.groupBy("queue").agg(
        F.count_if(F.col("what").startswith("run:") & (F.col("what") != "run:lease_expired")).alias("processed"), *(count(f"run:{o}").alias(n) for n, o in ended.items()),
        count("forwarded:pending").alias("forwarded_pending"), count("forwarded:aggregating").alias("forwarded_aggregating"),
        count("recovered:retry").alias("recovered_retry"), count("recovered:archived").alias("recovered_archived"), count("expired").alias("deleted_expired"),
    )
