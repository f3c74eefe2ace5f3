"""Registered queries of the streaming twins: each runs a stream over its whole table to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideq.plans.registry import query
from tideq.sources.tables import TASKS_SQL
from tideq.streaming import processors, runs

#: How far rows of the event table may come behind others.
LATE, _LATE_MS = "1 hour", 3_600_000


def _reached(column: str, where: str, table: str = "tasks", at: str = "enqueued_at") -> str:
    """SQL: whether ``column``, in milliseconds rounded up, is reached by the last watermark of a stream of the rows ``where``."""
    return f"(epoch_us({column}) + 999) // 1000 <= (select epoch_us(max({at})) // 1000 - {_LATE_MS} from {table} where {where})"


def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table as a stream, with its event time ``at``."""
    return spark.sql(TASKS_SQL, events=runs.event_stream(spark, sf_dir, "events")).withColumn("at", F.col("enqueued_at").cast("timestamp"))


_ENDS = "(f.n = 44 or least(f.oldest + interval 72 hour, f.moment + interval 8 hour) <= m.moment)"


@query(
    f""", m as (select queue, group_key, id, enqueued_at as moment, row_number() over (partition by queue, group_key order by enqueued_at, encode(id)) as rn
  from tasks where state = 'aggregating' and {_reached("enqueued_at", "state = 'aggregating'")}),
f as (select *, 1 as set_no, 1 as n, moment as oldest from m where rn = 1
  union all select m.*, case when {_ENDS} then f.set_no + 1 else f.set_no end, case when {_ENDS} then 1 else f.n + 1 end, case when {_ENDS} then m.moment else f.oldest end
  from f join m on m.queue = f.queue and m.group_key = f.group_key and m.rn = f.rn + 1),
s as (select queue, group_key, set_no, count(*) as n, min(moment) as oldest, max(moment) as newest from f group by 1, 2, 3),
c as (select *, case when n = 44 then newest else least(oldest + interval 72 hour, newest + interval 8 hour) end as closed_at,
  case when n = 44 then 'size' when oldest + interval 72 hour <= newest + interval 8 hour then 'delay' else 'grace' end as reason from s)
select f.queue, f.group_key, f.id, cast(f.set_no as bigint) as set_no, c.reason, c.closed_at
from f join c on f.queue = c.queue and f.group_key = c.group_key and f.set_no = c.set_no where {_reached("c.closed_at", "state = 'aggregating'")}""",
    recursive=True,
)
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = task_stream(spark, sf_dir).where("state = 'aggregating'")
    closed = runs.finished(processors.flush_stream(members, LATE, 44, 72 * 3600, 8 * 3600))
    return closed.select("queue", "group_key", "id", "set_no", "reason", F.col("closed_at").cast("timestamp_ntz").alias("closed_at"))


@query(f"""select queue, id, case when group_key <> '' then 'aggregating' else 'pending' end as outcome, process_at as due from tasks
where state in ('scheduled', 'retry') and {_reached("process_at", "state in ('scheduled', 'retry')")}""")
def stream_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = runs.finished(processors.forward_stream(task_stream(spark, sf_dir), LATE))
    return released.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query(f"""select queue, id, 'expired' as outcome, enqueued_at + to_seconds(retention) as due from tasks
where state = 'completed' and {_reached("enqueued_at + to_seconds(retention)", "state = 'completed'")}""")
def stream_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    expired = runs.finished(processors.expire_stream(task_stream(spark, sf_dir), LATE))
    return expired.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query(
    f"""with recursive e as (select user_id || ':' || event_type as key, event_id, ts, row_number() over (partition by user_id, event_type order by ts, encode(cast(event_id as varchar))) as rn
  from events where {_reached("ts", "true", "events", "ts")}),
f as (select *, true as accepted, ts as held from e where rn = 1
  union all select e.*, e.ts >= f.held + interval 1 hour, case when e.ts >= f.held + interval 1 hour then e.ts else f.held end from f join e on e.key = f.key and e.rn = f.rn + 1)
select key, cast(event_id as varchar) as id, accepted from f""",
    on_tasks=False,
)
def stream_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runs.event_stream(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return runs.finished(processors.unique_stream(events, 3600, LATE)).select("key", "id", "accepted")


@query(
    """select distinct t.id, t.enqueued_at as started_at from tasks t join tasks c on c.state = 'scheduled' and c.pos = t.pos + 2
  and c.enqueued_at >= t.enqueued_at and c.enqueued_at <= t.enqueued_at + interval 20 minute where t.state = 'active'"""
)
def stream_cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = task_stream(spark, sf_dir).where("state = 'active'").withColumn("started_at", F.col("at"))
    asked = task_stream(spark, sf_dir).where("state = 'scheduled'").select((F.col("pos") - 2).cast("string").alias("id"), "at")
    found = runs.finished(processors.cancelled_stream(active, asked, LATE, "20 minutes"))
    return found.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
