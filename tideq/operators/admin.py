"""Changes that an operator of the queues makes to the task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.operators.lifecycle import ARCHIVE_KEPT, newest
from tideq.operators.running import numbered

RUNNABLE = ("scheduled", "retry", "archived", "completed", "aggregating")
ARCHIVABLE = ("pending", "scheduled", "retry", "completed", "aggregating")
# Result codes of the states in which a task can't be changed.
RUN_REFUSED = {"active": -1, "pending": -2}
ARCHIVE_REFUSED = {"archived": -1, "active": -2}
DELETE_REFUSED = {"active": -1}


def code(wanted: DataFrame, tasks: DataFrame, allowed: tuple[str, ...], to: str, refused: dict[str, int]) -> DataFrame:
    """queue, id, result, new_state for each wanted task, once however often it is named.

    1: changed; 0: not found; else the code that ``refused`` has for the task's state.
    """
    joined = wanted.select("queue", "id").distinct().join(tasks.select("queue", "id", "state"), ["queue", "id"], "left")
    result = F.when(F.col("state").isNull(), 0).when(F.col("state").isin(*allowed), 1)
    for state, number in refused.items():
        result = result.when(F.col("state") == state, number)
    return joined.select("queue", "id", result.alias("result"), F.when(result == 1, F.lit(to)).otherwise(F.col("state")).alias("new_state"))


def run_task(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    return code(wanted, tasks, RUNNABLE, "pending", RUN_REFUSED)


def archive_task(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    return code(wanted, tasks, ARCHIVABLE, "archived", ARCHIVE_REFUSED)


def delete_task(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    return code(wanted, tasks, (*ARCHIVABLE, "archived"), "deleted", DELETE_REFUSED)


def update_payload(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scheduled tasks named in ``wanted`` (queue, id, new_payload) with that payload; of several for one task the largest."""
    once = wanted.groupBy("queue", "id").agg(F.max("new_payload").alias("new_payload"))
    found = tasks.where("state = 'scheduled'").join(once, ["queue", "id"])
    return found.withColumn("payload", F.col("new_payload")).drop("new_payload")


def update_payload_codes(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """queue, id, result for each wanted task: 1 updated, 0 not found, -1 in a state whose payload can't be changed."""
    joined = wanted.select("queue", "id").distinct().join(tasks.select("queue", "id", "state"), ["queue", "id"], "left")
    return joined.select("queue", "id", F.when(F.col("state").isNull(), 0).when(F.col("state") == "scheduled", 1).otherwise(-1).alias("result"))


def run_all(tasks: DataFrame, states: tuple[str, ...], group: str | None = None) -> DataFrame:
    """Tasks of the states (of one group, if named) as pending, after all that are pending already."""
    chosen = _chosen(tasks, states, group)
    last = tasks.where("state = 'pending'").groupBy("queue").agg(F.max("pos").alias("last"))
    return (
        numbered(chosen, ["queue"], F.col("pos"), ["pos", "id"], "n").join(last, "queue", "left")
        .withColumn("pos", F.coalesce("last", F.lit(0)) + F.col("n")).withColumn("state", F.lit("pending")).drop("n", "last")
    )


def archive_all(tasks: DataFrame, states: tuple[str, ...], group: str | None = None, kept: int = ARCHIVE_KEPT) -> DataFrame:
    """The archive of each queue once the tasks of the states have joined it, cut to the newest; moved ones come after old ones."""
    return joined_archive(tasks.where("state = 'archived'"), _chosen(tasks, states, group), kept)


def joined_archive(archived: DataFrame, joining: DataFrame, kept: int = ARCHIVE_KEPT) -> DataFrame:
    """The newest ``kept`` of each queue's archive once ``joining`` has come to it, with moved: 1 for what has."""
    both = archived.withColumn("moved", F.lit(0)).unionByName(joining.withColumn("moved", F.lit(1)))
    return newest(both, kept, "moved").withColumn("state", F.lit("archived"))


def delete_all(tasks: DataFrame, states: tuple[str, ...], group: str | None = None) -> DataFrame:
    """Deleted tasks by queue and state, and whether their uniqueness locks go too: not for pending and grouped ones."""
    return _chosen(tasks, states, group).groupBy("queue", "state").agg(F.count("*").alias("deleted")).withColumn("releases_locks", ~F.col("state").isin("pending", "aggregating"))


def _chosen(tasks: DataFrame, states: tuple[str, ...], group: str | None) -> DataFrame:
    chosen = tasks.where(F.col("state").isin(*states))
    return chosen if group is None else chosen.where(F.col("group_key") == group)


def pause(queues: DataFrame, names: list[str], now: Column) -> DataFrame:
    """``queues`` (queue, paused_at) with the named ones paused; result is 1, or 0 if one already was."""
    hit = F.col("queue").isin(*names)
    return queues.select("queue", F.when(hit, F.coalesce("paused_at", now)).otherwise(F.col("paused_at")).alias("paused_at"), F.when(hit, F.col("paused_at").isNull().cast("int")).alias("result"))


def unpause(queues: DataFrame, names: list[str]) -> DataFrame:
    hit = F.col("queue").isin(*names)
    return queues.select("queue", F.when(~hit, F.col("paused_at")).alias("paused_at"), F.when(hit, F.col("paused_at").isNotNull().cast("int")).alias("result"))


def delete_queue(tasks: DataFrame, force: bool = False) -> DataFrame:
    """queue, result for each queue: 1 may be deleted, -1 not empty, or -2 (forced) has active tasks."""
    held = ("active",) if force else ("pending", "active", "scheduled", "retry", "archived")
    return tasks.groupBy("queue").agg(F.when(F.count_if(F.col("state").isin(*held)) == 0, 1).otherwise(-2 if force else -1).alias("result"))


def release_locks(locks: DataFrame, ended: DataFrame) -> DataFrame:
    """``locks`` (key, owner_id) without those that an ended task (unique_key, id) still owns."""
    gone = ended.select(F.col("unique_key").alias("key"), F.col("id").alias("owner_id")).distinct()
    return locks.join(gone, ["key", "owner_id"], "left_anti")
