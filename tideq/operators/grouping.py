"""Grouped batches: when a group is flushed, and with which members."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideq.functions.scalar import now_of
from tideq.operators.running import numbered, running_sum


def flush_decision(tasks: DataFrame, now: str, max_size: int, max_delay: int, grace: int) -> DataFrame:
    """queue, group_key, n, reason for each open group; a size or delay (seconds) of 0 sets no bound."""
    groups = tasks.where("state = 'aggregating'").groupBy("queue", "group_key").agg(
        F.count("*").alias("n"), F.min("enqueued_at").alias("oldest"), F.max("enqueued_at").alias("newest")
    )
    before = lambda seconds: now_of(now) - F.make_interval(secs=F.lit(seconds))
    reason = (
        F.when((F.lit(max_size) != 0) & (F.col("n") >= max_size), "size")
        .when((F.lit(max_delay) != 0) & (F.col("oldest") <= before(max_delay)), "delay")
        .when(F.col("newest") <= before(grace), "grace")
        .otherwise("none")
    )
    return groups.select("queue", "group_key", "n", reason.alias("reason"))


def flush_set(tasks: DataFrame, now: str, max_size: int, max_delay: int, grace: int) -> DataFrame:
    """Members of the set that one check closes for each group: the first by arrival and id."""
    due = flush_decision(tasks, now, max_size, max_delay, grace).where("reason <> 'none'").select("queue", "group_key", "reason")
    chosen = tasks.where("state = 'aggregating'").join(due, ["queue", "group_key"])
    moment = F.unix_micros(F.col("enqueued_at").cast("timestamp"))
    members = numbered(chosen, ["queue", "group_key"], moment, ["enqueued_at", F.col("id").cast("binary")], "rn").withColumn("rn", F.col("rn").cast("int"))
    return members.where(F.col("rn") <= max_size) if max_size else members


def group_aggregate(members: DataFrame) -> DataFrame:
    """One task for each set: how many members it has, and their payloads in order."""
    listed = F.array_sort(F.collect_list(F.struct("rn", "payload")))
    return members.groupBy("queue", "group_key").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["payload"]), "\n").alias("payload"))


def reclaim(sets: DataFrame, now: str) -> DataFrame:
    """Members (with set_id, deadline) whose set is past its deadline, back in their group."""
    return sets.where(F.col("deadline") <= now_of(now)).withColumn("set_id", F.lit(None).cast("string"))


def delete_sets(members: DataFrame, done: DataFrame) -> DataFrame:
    """``members`` (queue, group_key, set_id, ...) without those of the sets in ``done`` (queue, group_key, set_id)."""
    return members.join(done.select("queue", "group_key", "set_id").distinct(), ["queue", "group_key", "set_id"], "left_anti")


#: Seconds that a set may take to be aggregated.
SET_SECONDS = 120


def checks_before(rows: DataFrame, checks: DataFrame, times: dict[str, str]) -> DataFrame:
    """``rows`` (queue, group_key, id, enqueued_at) with, for each name of ``times``, how many checks (queue, at) of the queue are before that time.

    ``times``: SQL expressions over ``rows``. Rows and checks are merged into one order and counted in slices of time, so
    no queue is in one task whole.
    """
    asked = F.array(*(F.struct(F.lit(n).alias("name"), F.unix_micros(F.expr(e).cast("timestamp")).alias("x")) for n, e in times.items()))
    key = ["queue", "group_key", "id", "enqueued_at"]
    wanted = rows.select(*key, F.explode(asked).alias("a")).select(*key, "a.name", "a.x", F.lit(0).alias("check"))
    both = wanted.unionByName(checks.select("queue", F.unix_micros(F.col("at").cast("timestamp")).alias("x"), F.lit(1).alias("check")), allowMissingColumns=True)
    counted = running_sum(both, ["queue"], F.col("x"), ["x", "check"], F.col("check"), "n", inclusive=False).where("check = 0")
    return counted.groupBy(*key).agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in times))


def sets_at_checks(members: DataFrame, checks: DataFrame, max_size: int, max_delay: int, grace: int) -> DataFrame:
    """Members (queue, group_key, id, enqueued_at) that checks (queue, at; times unique) close into sets: with set_no, rn, reason, check_at, deadline.

    A check sees the members that came until its time, closes at most one set of each group, and takes the first
    by arrival and id, as ``flush_decision`` and ``flush_set`` do; what is left waits for the next check.
    Members must be unique in id. The rules are turned into numbers of checks beforehand; a group's members then pass by in order, and
    only those still waiting are held. A group is one task's work, as each set depends on those before.
    """
    times = {"seen": "enqueued_at", "old": f"enqueued_at + make_interval(0, 0, 0, 0, 0, 0, {max_delay})", "quiet": f"enqueued_at + make_interval(0, 0, 0, 0, 0, 0, {grace})"}
    before = checks_before(members, checks, times)
    last = checks.groupBy("queue").agg(F.count("*").alias("checks"))
    numbers = before.select("queue", "group_key", "id", "enqueued_at", *((F.col(n) + 1).alias(n) for n in times)).join(last, "queue")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, taken_at, number, newest, out = None, deque(), 0, 0, None, []

        def settle(until: int) -> None:
            """Closes what the checks numbered below ``until`` close."""
            nonlocal taken_at, number
            while held:
                first = max(taken_at + 1, newest[0])
                if max_size and len(held) >= max_size:
                    at, reason = first, "size"
                else:
                    by_grace = max(first, newest[2])
                    by_delay = max(first, held[0][2]) if max_delay else by_grace + 1
                    at, reason = (by_delay, "delay") if by_delay <= by_grace else (by_grace, "grace")
                if at >= until:
                    return
                taken_at, number = at, number + 1
                for rn in range(1, min(len(held), max_size or len(held)) + 1):
                    id_, when, _ = held.popleft()
                    out.append((*group, id_, when, number, rn, reason, at))

        end = 0
        for batch in batches:
            for queue, key, id_, when, seen, old, quiet, last_check in zip(*(batch[c] for c in ("queue", "group_key", "id", "enqueued_at", "seen", "old", "quiet", "checks"))):
                if (queue, key) != group:
                    settle(end + 1)
                    held.clear()
                    group, taken_at, number, end = (queue, key), 0, 0, last_check
                elif seen > newest[0]:
                    settle(seen)
                newest = (seen, old, quiet)
                held.append((id_, when, old))
            yield pd.DataFrame(out, columns=columns)
            out = []
        settle(end + 1)
        yield pd.DataFrame(out, columns=columns)

    columns = ["queue", "group_key", "id", "enqueued_at", "set_no", "rn", "reason", "check_no"]
    types = dict(members.dtypes)
    schema = f"queue string, group_key string, id {types['id']}, enqueued_at {types['enqueued_at']}, set_no long, rn int, reason string, check_no long"
    order = ["queue", "group_key", "enqueued_at", F.col("id").cast("binary")]
    closed = numbers.repartition("queue", "group_key").sortWithinPartitions(*order).mapInPandas(fold, schema)
    named = numbered(checks, ["queue"], F.unix_micros(F.col("at").cast("timestamp")), ["at"], "check_no").select("queue", "check_no", F.col("at").alias("check_at"))
    return closed.join(named, ["queue", "check_no"]).drop("check_no").withColumn("deadline", F.col("check_at") + F.make_interval(secs=F.lit(SET_SECONDS)))


def run_sets(sets: DataFrame, finished_at: str) -> tuple[DataFrame, DataFrame]:
    """The tasks that aggregated sets become, and the members that go back to their groups.

    ``sets``: members of ``sets_at_checks`` with payload; ``finished_at`` names the column of the time when a set's aggregator ended. A set
    that ends before its deadline becomes one pending task (queue, group_key, set_no, id, n, payload of its members in order, added_at) and its
    members are gone; one that doesn't adds nothing and its members are reclaimed at the deadline.
    """
    fine = F.col(finished_at) < F.col("deadline")
    key = ["queue", "group_key", "set_no"]
    listed = F.array_sort(F.collect_list(F.struct("rn", "payload")))
    added = sets.where(fine).groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["payload"]), "\n").alias("payload"), F.max(finished_at).alias("added_at"))
    tasks = added.withColumn("id", F.concat_ws(":", "queue", "group_key", F.col("set_no").cast("string"))).withColumn("state", F.lit("pending"))
    back = sets.where(~fine).select("queue", "group_key", "id", "enqueued_at", F.col("deadline").alias("reclaimed_at"))
    return tasks, back
