"""Adding tasks: planning, id conflicts, time-limited uniqueness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.functions.scalar import epoch, is_blank, now_of, unique_key
from tideq.operators.running import running_max, running_sum

DEFAULT_RETRY = 25
DEFAULT_TIMEOUT_SECONDS = 1800


#: Columns of a request that ``plan`` keeps by itself.
PLANNED = ("queue", "type", "id", "group_key", "process_at")
#: Spans beyond it don't fit a signed 64-bit count of nanoseconds.
LONGEST_SECONDS = (2**63 - 1) // 10**9


def plan(requests: DataFrame, now: str | Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` (queue, type, id, max_retries, timeout, deadline, process_at, process_in, group_key, unique_for) with error, state, defaults.

    ``process_in`` (seconds) wins over ``process_at``. A delayed task with a
    group is scheduled first. A timeout is set only if there is no deadline either.
    ``now`` may be a column: then each request has a clock of its own. A column ``retain_for`` (seconds) becomes
    ``retention``, 0 by default; columns of ``carry`` are kept. Spans that don't fit a 64-bit count of nanoseconds are refused.
    """
    clock = now_of(now)
    due = F.when(F.col("process_in").isNotNull(), clock + F.make_interval(secs=F.col("process_in"))).otherwise(F.col("process_at"))
    blank = lambda c: F.coalesce(is_blank(F.col(c)), F.lit(False))
    spans = [c for c in ("timeout", "unique_for", "retain_for") if c in requests.columns]
    error = (
        F.when(blank("type"), "blank type")
        .when(blank("queue"), "blank queue")
        .when(blank("id"), "blank id")
        .when(blank("group_key"), "blank group")
        .when(F.col("unique_for") < 1, "unique time below a second")
        .when(F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in spans)) > LONGEST_SECONDS, "span too long")
    )
    planned = requests.withColumn("process_at", due).withColumn("queue", F.coalesce("queue", F.lit("default")))
    state = F.when(F.col("process_at") > clock, "scheduled").when(F.col("group_key").isNotNull(), "aggregating").otherwise("pending")
    lock = F.when(F.col("process_at") > clock, epoch(F.col("process_at")) + F.col("unique_for") - epoch(clock)).otherwise(F.col("unique_for"))
    no_limit = (F.coalesce("timeout", F.lit(0)) == 0) & (F.coalesce("deadline", F.lit(0)) == 0)
    retention = [F.coalesce("retain_for", F.lit(0)).cast("bigint").alias("retention")] if "retain_for" in requests.columns else []
    return planned.select(
        "queue", "type", "id", error.alias("error"), F.when(error.isNull(), state).alias("state"),
        F.coalesce("max_retries", F.lit(DEFAULT_RETRY)).alias("max_retries"),
        F.when(no_limit, F.lit(DEFAULT_TIMEOUT_SECONDS)).otherwise(F.coalesce("timeout", F.lit(0))).cast("bigint").alias("timeout"),
        lock.cast("bigint").alias("lock_seconds"), "process_at", "group_key", *retention, *carry,
    )


def admit(requests: DataFrame, tasks: DataFrame, at: str, tie: str | list[str], ends: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each request (as of ``plan``, with payload, ``at`` and ``tie``) planned at its own time, with unique_key and status; columns of ``carry`` are kept.

    Status: 1 added in its planned state; 0 the id is taken; -1 the lock of its queue, type and payload
    is held by another task; null if the request has an error. Requests without ``unique_for`` ask for no lock.
    A task of ``ends`` (queue, type, payload, id, ``at``) that owns its lock releases it when it ends.
    """
    key = lambda: unique_key(F.col("queue"), F.col("type"), F.col("payload")).alias("unique_key")
    ties = [tie] if isinstance(tie, str) else tie
    planned = plan(requests, F.col(at), carry=(at, *(t for t in ties if t not in PLANNED), "payload", *carry)).select("*", key())
    ended = None if ends is None else ends.select(key(), "id", at)
    fine = unique_status(planned.where("error is null"), tasks, ["unique_key"], at, "lock_seconds", ties, ended)
    return fine.unionByName(planned.where("error is not null").withColumn("status", F.lit(None).cast("int")))


def with_status(requests: DataFrame, tasks: DataFrame, arrival: str | list[str]) -> DataFrame:
    """``requests`` with status: 1 added, 0 the id is taken in that queue, by a task or a request of earlier ``arrival``, which no two share."""
    return _with_status(requests, tasks, [arrival] if isinstance(arrival, str) else arrival, F.lit(True))


def _with_status(requests: DataFrame, tasks: DataFrame, order: list[str], asks: Column) -> DataFrame:
    """As ``with_status``, among the requests that ``asks`` picks; -1 for the others.

    The first request of an id is found by a grouped minimum, so that an id asked for by many is in no task whole.
    """
    taken = tasks.select("queue", "id", F.lit(True).alias("taken")).distinct()
    first = requests.where(asks).groupBy(F.col("queue").alias("_q"), F.col("id").alias("_i")).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.col("queue").eqNullSafe(F.col("_q")) & F.col("id").eqNullSafe(F.col("_i"))
    joined = requests.join(first, same, "left").drop("_q", "_i").join(taken, ["queue", "id"], "left")
    added = F.col("taken").isNull() & (F.struct(*order) == F.col("_first"))
    return joined.withColumn("status", F.when(~asks, -1).when(added, 1).otherwise(0)).drop("_first", "taken")


def unique_status(requests: DataFrame, tasks: DataFrame, key: list[str], at: str, ttl: str, tie: str | list[str], ends: DataFrame | None = None) -> DataFrame:
    """``requests`` (queue, id among their columns) with status: -1 the key is locked, 0 the id is taken, 1 added.

    The lock is taken before the id is looked up, and stays when the id is taken;
    column ``ttl`` has each request's lock time in seconds, and a request without one asks for no lock. Requests come one
    after the other by ``at`` and ``tie``, a column or several, which no two of them share. ``ends`` as in ``unique``.
    """
    return _with_status(unique(requests, key, at, ttl, tie, ends), tasks, [at, *([tie] if isinstance(tie, str) else tie)], F.col("accepted")).drop("accepted")


def unique(requests: DataFrame, key: list[str], at: str, ttl: int | str, tie: str | list[str], ends: DataFrame | None = None) -> DataFrame:
    """``requests`` with accepted: whether the lock of no accepted one of the same key still holds; ``ttl`` is its seconds, or their column.

    A refused request doesn't prolong the lock, so the rows of a key are taken
    in turn. ``ends`` (key, id, at) are ends of tasks: one releases its key's lock at once if the task (``id``) owns it,
    before requests of the same time. Where a row comes after the end of every lock that those before it
    can have taken, a key's rows are cut, and the bursts are dealt out by themselves,
    sorted, and folded row by row, with no burst held in memory; the cuts are found in slices of time, no key being sorted as a whole.
    A burst, whose locks follow each other without a pause, is one task's work: each of its rows depends on those before.
    """
    seconds = F.lit(ttl) if isinstance(ttl, int) else F.col(ttl)
    rows = requests.withColumn("_at", epoch_micros(F.col(at))).withColumn("_until", F.col("_at") + seconds.cast("bigint") * 1_000_000).withColumn("_end", F.lit(False))
    owner = "id" if ends is not None else None
    if ends is not None:
        rows = rows.unionByName(ends.select(*key, "id", epoch_micros(F.col(at)).alias("_at"), F.lit(True).alias("_end")), allowMissingColumns=True)
    moment, order = F.col("_at"), ["_at", F.desc("_end"), *([tie] if isinstance(tie, str) else tie)]
    cut = running_max(rows, key, moment, order, F.col("_until"), "_last")
    cut = running_sum(cut, key, moment, order, F.coalesce((F.col("_at") >= F.col("_last")).cast("int"), F.col("_last").isNull().cast("int")), "_burst").drop("_last")

    names = requests.columns
    parts = [*key, "_burst"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until, held_by = None, 0, None
        for batch in batches:
            out = []
            owners = batch[owner] if owner else [None] * len(batch)
            named = [batch[c].astype(object).where(batch[c].notna(), None) for c in parts]  # a null number is NaN, which equals nothing
            for burst, moment, end, is_end, who in zip(zip(*named), batch["_at"], batch["_until"], batch["_end"], owners):
                if burst != last:
                    last, until, held_by = burst, moment, None
                free = moment >= until
                if is_end:
                    until = moment if not free and who == held_by else until
                elif end == end and end is not None and free:  # NaN: asks for no lock
                    until, held_by = int(end), who
                out.append(free or is_end or not (end == end and end is not None))
            kept = ~batch["_end"].to_numpy(bool)
            yield batch.assign(accepted=out)[kept][[*names, "accepted"]]

    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes) + ", accepted boolean"
    return cut.repartition(*parts).sortWithinPartitions(*parts, *order).mapInPandas(fold, schema)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
