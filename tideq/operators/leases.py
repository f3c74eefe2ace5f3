"""Leases of running tasks: when they are extended, and the spans that no lease covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideq.operators.running import running_max, running_sum
from tideq.operators.timers import GRACE_SECONDS

#: When a running handler's lease is extended: never, once before it begins, or again and again while it runs.
POLICIES = ("none", "before", "every")


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def extensions(runs: DataFrame, policy: str, seconds: int = 0) -> DataFrame:
    """``runs`` (task_id, started_at, ended_at) as rows (task_id, at, kind): the start, and the extensions that ``policy`` makes.

    ``every`` extends each ``seconds`` after the start until the end; a run without an end so far has none that can be told.
    """
    if policy not in POLICIES or policy == "every" and seconds < 1:
        raise ValueError(f"policy {policy!r} with {seconds} seconds")
    starts = runs.select("task_id", F.col("started_at").alias("at"), F.lit("start").alias("kind"))
    if policy == "none":
        return starts
    if policy == "before":
        return starts.unionByName(starts.withColumn("kind", F.lit("beat")))
    step = F.make_dt_interval(secs=F.lit(seconds))
    some = runs.where(F.col("started_at") + step < F.col("ended_at"))
    beats = some.select("task_id", F.explode(F.sequence(F.col("started_at") + step, "ended_at", step)).alias("at"), "ended_at").where("at < ended_at")
    return starts.unionByName(beats.select("task_id", "at", F.lit("beat").alias("kind")))


def lease_spans(beats: DataFrame, grace: int = GRACE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Runs and gaps of ``beats`` (task_id, at, tie, kind, lease): each row asks for a lease of so many seconds from its time.

    A ``start`` begins a run with a new lease. Another row extends the run's lease, also if that has
    run out, but not once ``grace`` seconds have passed since then: the task has been taken back, and what comes until the
    next start is refused. Rows before a task's first start have no run.

    Runs: task_id, run, started_at, leased_until, extended, refused. Gaps: task_id, run, gap_from, gap_to (null: open), lost: whether the task was taken back.
    """
    order, moment = ["at", "tie"], _micros(F.col("at"))
    rows = beats.withColumn("_until", _micros(F.col("at")) + F.col("lease").cast("long") * 1_000_000)
    runs = running_sum(rows, ["task_id"], moment, order, (F.col("kind") == "start").cast("int"), "run").where("run > 0")
    held = running_max(runs, ["task_id", "run"], moment, order, F.col("_until"), "_held")
    late = _micros(F.col("at")) - F.col("_held")
    lost = F.coalesce((late >= grace * 1_000_000).cast("int"), F.lit(0))
    told = running_sum(held.withColumn("_late", late), ["task_id", "run"], moment, order, lost, "_lost")
    kept = F.col("_lost") == 0
    by_run = told.groupBy("task_id", "run").agg(
        F.min("at").alias("started_at"),
        F.max(F.when(kept, F.col("_until"))).alias("_end"),
        (F.count_if(kept) - 1).alias("extended"),
        F.count_if(~kept).alias("refused"),
    )
    followed = by_run.withColumn("_next", F.lead("started_at").over(Window.partitionBy("task_id").orderBy("run")))
    end = F.timestamp_micros("_end").cast("timestamp_ntz")
    inside = told.where(kept & (F.col("_late") > 0)).select("task_id", "run", F.timestamp_micros("_held").cast("timestamp_ntz").alias("gap_from"), F.col("at").alias("gap_to"), F.lit(False).alias("lost"))
    behind = _micros(F.col("_next")) - F.col("_end")
    after = followed.where("_next is null or " + "unix_micros(cast(_next as timestamp)) > _end")
    after = after.select("task_id", "run", end.alias("gap_from"), F.col("_next").alias("gap_to"), F.coalesce(behind >= grace * 1_000_000, F.lit(True)).alias("lost"))
    return followed.select("task_id", "run", "started_at", end.alias("leased_until"), "extended", "refused"), inside.unionByName(after)


def active_workers(transitions: DataFrame) -> DataFrame:
    """The last row of each task in ``transitions`` (task_id, at, tie, kind, ...) that is no ``end``: what is being worked on."""
    rest = [c for c in transitions.columns if c != "task_id"]
    last = transitions.where(F.col("kind").isin("start", "end")).groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct("at", "tie")).alias("t"))
    return last.select("task_id", "t.*").where("kind = 'start'")
