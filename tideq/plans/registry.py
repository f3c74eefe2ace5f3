"""Every registered query, with equivalent SQL for the oracle where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideq.functions import scalar
from tideq.operators import admin, enqueue, grouping, handlers, inspect, lifecycle, presence, schedule, timers
from tideq.sources.tables import NOW, TASKS_SQL, read, tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_CLOCK = f"timestamp '{NOW}'"
_TASKS = f"with tasks as ({TASKS_SQL.format(events='events')})\n"
_STATES = ", ".join(f"count(*) filter (state = '{s}') as {s}" for s in scalar.STATES)
#: Bounds of the flush rules, scaled so that each of them fires on the test tables.
FLUSH = {"max_size": 44, "max_delay": 444 * 3600, "grace": 8 * 3600}


def query(sql: str | None = None, on_tasks: bool = True, recursive: bool = False) -> Callable:
    """Registers a query, with its SQL if there is any; ``$NOW`` is the clock, and ``tasks`` the task table unless not ``on_tasks``."""
    tasks_sql = _TASKS.replace("with", "with recursive", 1) if recursive else _TASKS

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (tasks_sql if on_tasks else "") + sql.replace("$NOW", _CLOCK)
        return f

    return add


# ---- inspection ------------------------------------------------------------


@query(
    f"""select queue, count(*) as size, {_STATES}, count(distinct group_key) filter (state = 'aggregating') as groups,
  count(*) filter (state in ('completed', 'retry', 'archived')) as processed, count(*) filter (state in ('retry', 'archived')) as failed,
  arg_min(enqueued_at, pos) filter (state = 'pending') as oldest_pending,
  coalesce(greatest(cast(floor(epoch($NOW) - floor(epoch(arg_min(enqueued_at, pos) filter (state = 'pending')))) as bigint), 0), 0) as latency
from tasks group by queue"""
)
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.queue_stats(tasks(spark, sf_dir), NOW)


@query("select queue, count(*) as size from tasks group by queue")
def queue_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).groupBy("queue").agg(F.count("*").alias("size"))


@query("select queue, cast(greatest(floor(epoch($NOW)) - floor(epoch(arg_min(enqueued_at, pos))), 0) as bigint) as latency from tasks where state = 'pending' group by queue")
def pending_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.queue_stats(tasks(spark, sf_dir).where("state = 'pending'"), NOW).select("queue", "latency")


@query(
    """select q.queue, cast(d.day as date) as day, coalesce(processed, 0) as processed, coalesce(failed, 0) as failed
from (select distinct queue from tasks) q cross join (select unnest(generate_series(date '2024-01-06', date '2024-01-20', interval 1 day)) as day) d
left join (select queue, cast(enqueued_at as date) as day, count(*) filter (state in ('completed', 'retry', 'archived')) as processed,
  count(*) filter (state in ('retry', 'archived')) as failed from tasks group by 1, 2) c on c.queue = q.queue and c.day = cast(d.day as date)"""
)
def history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.history(tasks(spark, sf_dir), NOW, 15)


@query("select queue, group_key, count(*) as size from tasks where state = 'aggregating' group by 1, 2")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.group_sizes(tasks(spark, sf_dir))


@query(
    """select c.queue, cast(sum(cast(floor(mean * n) as bigint)) as bigint) as bytes
from (select queue, state, count(*) as n from tasks group by 1, 2) c
join (select queue, state, cast(sum(strlen(payload)) as double) / count(*) as mean
  from (select *, row_number() over (partition by queue, state order by pos, id) as rn from tasks) where rn <= 20 group by 1, 2) m
on c.queue = m.queue and c.state = m.state group by c.queue"""
)
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.memory_estimate(tasks(spark, sf_dir))


def _listing(name: str, state: str, order: str, page: int, size: int, extra: str = "", group: str | None = None) -> None:
    where = f"state = '{state}'" + (f" and group_key = '{group}'" if group else "")
    due = {"pending": "$NOW", "scheduled": "process_at", "retry": "process_at"}.get(state, "cast(null as timestamp)")
    orphan = "lease_expires_at <= $NOW - interval 30 second" if state == "active" else "false"
    sql = f"""select queue, id, type, rn, {due} as next_process_at, {orphan} as is_orphaned from (
  select *, cast(row_number() over (partition by queue order by {order}) as integer) as rn from tasks where {where}) where rn > {(page - 1) * size} and rn <= {page * size}"""

    def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = inspect.list_tasks(tasks(spark, sf_dir), state, page, size, group)
        orphaned = inspect.orphaned(NOW) if state == "active" else F.lit(False)
        return found.select("queue", "id", "type", "rn", inspect.next_process_at(NOW).cast("timestamp_ntz").alias("next_process_at"), orphaned.alias("is_orphaned"))

    listing.__name__ = name
    query(sql)(listing)


_listing("list_pending", "pending", "pos", 2, 30)
_listing("list_active_orphans", "active", "pos", 1, 30)
_listing("list_scheduled", "scheduled", "process_at, encode(id)", 1, 30)
_listing("list_retry", "retry", "process_at, encode(id)", 2, 10)
_listing("list_archived", "archived", "enqueued_at, encode(id)", 1, 30)
_listing("list_completed", "completed", "enqueued_at, encode(id)", 3, 25)
_listing("list_aggregating", "aggregating", "enqueued_at, encode(id)", 1, 30, group="g3")


@query(
    """select queue, id, type, state, retry, retried, case when state in ('scheduled', 'retry') then process_at when state = 'pending' then $NOW end as next_process_at
from tasks where queue = 'default' and id in ('1', '20', '48', '100', '368', '409')"""
)
def task_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.task_info(tasks(spark, sf_dir), "default", ["1", "20", "48", "100", "368", "409"], NOW)


@query("select distinct queue from tasks")
def list_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("queue").distinct()


@query(
    """select n_nationkey as server_id, n_name as host, s_suppkey as task_id, s_name as task_type
from nation left join supplier on s_nationkey = n_nationkey and s_suppkey % 5 <> 0 where n_nationkey % 4 <> 0""",
    on_tasks=False,
)
def servers_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.lit(NOW).cast("timestamp")
    expires = lambda key, n: F.when(F.col(key) % n == 0, clock - F.expr("interval 1 second")).otherwise(clock)
    servers = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("server_id"), F.col("n_name").alias("host"), expires("n_nationkey", 4).alias("expires_at"))
    workers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("server_id"), F.col("s_suppkey").cast("bigint").alias("task_id"), F.col("s_name").alias("task_type"), expires("s_suppkey", 5).alias("expires_at"))
    nested = inspect.servers_with_workers(servers, workers, clock)
    return nested.select("server_id", "host", F.explode_outer("active_workers").alias("w")).select("server_id", "host", "w.task_id", "w.task_type")


@query(
    """select entry_id, task_id, enqueued_at from (select user_id as entry_id, event_id as task_id, ts as enqueued_at,
  row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 1000 and rn > 3 and rn <= 6""",
    on_tasks=False,
)
def scheduler_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr("user_id entry_id", "event_id task_id", "ts enqueued_at")
    return inspect.scheduler_events(events, 2, 3).drop("rn")


@query(
    """select server_id, event_id, status from (select user_id % 40 as server_id, event_id, event_type as status, ts + interval 10 day as expires_at,
  row_number() over (partition by user_id % 40 order by ts desc, event_id desc) as rn from events) where rn = 1 and expires_at >= $NOW and server_id % 7 <> 0""",
    on_tasks=False,
)
def server_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "events").selectExpr("user_id % 40 server_id", "event_id", "event_type status", "ts", "ts + interval '10' day expires_at")
    now = scalar.now_of(NOW)
    known = presence.live(presence.latest(reports, ["server_id"], "ts", "event_id"), now)
    return presence.without(known, known.where("server_id % 7 = 0"), ["server_id"]).select("server_id", "event_id", "status")


@query(
    """select user_id % 20 as scheduler_id, event_id as entry_id, case when event_id % 3 <> 0 then ts end as prev_at
from events where (user_id % 20) % 4 <> 0""",
    on_tasks=False,
)
def scheduler_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("scheduler_id", F.col("user_id") % 20)
    prev = F.expr("case when event_id % 3 = 0 then timestamp_ntz '0001-01-01 00:00:00' else ts end")
    listed = rows.select("scheduler_id", F.col("event_id").alias("entry_id"), prev.alias("prev_at"))
    expires = F.expr(f"timestamp_ntz '{NOW}' - make_interval(0, 0, 0, 0, 0, 0, case when scheduler_id % 4 = 0 then 1 else 0 end)")
    reports = rows.select("scheduler_id").distinct().withColumn("expires_at", expires)
    return presence.entries(reports, listed, scalar.now_of(NOW))


@query("select id from tasks t where state = 'active' and exists (select 1 from tasks c where c.state = 'scheduled' and c.pos = t.pos + 2 and c.enqueued_at >= t.enqueued_at)")
def cancelled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    asked = known.where("state = 'scheduled'").select((F.col("pos") - 2).cast("string").alias("id"), F.col("enqueued_at").alias("at"))
    return presence.cancelled(known.where("state = 'active'").withColumn("started_at", F.col("enqueued_at")), asked).select("id")


# ---- enqueue ---------------------------------------------------------------

_REQUESTS = """select case o_orderkey % 50 when 0 then ' ' when 1 then null else lower(o_orderstatus) end as queue,
  case when o_orderkey % 40 = 3 then '' else o_orderpriority end as type, cast(o_orderkey as {string}) as id,
  case when o_orderkey % 3 = 0 then cast(o_orderkey % 7 as int) end as max_retries, cast(o_orderkey % 4 * 60 as bigint) as timeout,
  cast(case when o_orderkey % 5 = 0 then 1706000000 else 0 end as bigint) as deadline,
  case when o_orderkey % 6 = 0 then timestamp '2024-01-21 00:00:00' when o_orderkey % 6 = 1 then timestamp '2024-01-19 00:00:00' end as process_at,
  case when o_orderkey % 9 = 0 then 90 end as process_in, case when o_orderkey % 8 = 0 then 'g1' when o_orderkey % 8 = 1 then '  ' end as group_key,
  cast(case when o_orderkey % 11 = 0 then 0 when o_orderkey % 11 = 1 then 600 end as bigint) as unique_for from {orders}"""
_REQUESTS_DUCK = _REQUESTS.format(string="varchar", orders="orders")


@query(
    f"""with asked as ({_REQUESTS_DUCK}), r as (
  select * replace (case when process_in is not null then $NOW + to_seconds(process_in) else process_at end as process_at, coalesce(queue, 'default') as queue) from asked
), e as (select *, case when trim(type) = '' then 'blank type' when trim(queue) = '' then 'blank queue' when trim(id) = '' then 'blank id'
  when trim(group_key) = '' then 'blank group' when unique_for < 1 then 'unique time below a second' end as error from r)
select queue, type, id, error, case when error is null then case when process_at > $NOW then 'scheduled' when group_key is not null then 'aggregating' else 'pending' end end as state,
  coalesce(max_retries, 25) as max_retries, cast(case when timeout = 0 and deadline = 0 then 1800 else timeout end as bigint) as timeout,
  cast(case when process_at > $NOW then cast(epoch(process_at) as bigint) + unique_for - cast(epoch($NOW) as bigint) else unique_for end as bigint) as lock_seconds, process_at, group_key
from e""",
    on_tasks=False,
)
def enqueue_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(_REQUESTS.format(string="string", orders="{orders}"), orders=read(spark, sf_dir, "orders"))
    return enqueue.plan(requests, NOW)


@query(
    """select r.queue, r.id, r.arrival, case when t.id is null and r.nth = 1 then 1 else 0 end as status from (
  select *, row_number() over (partition by queue, id order by arrival) as nth from (
    select case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end as queue, cast(event_id // 2 + 3000 as varchar) as id, event_id as arrival from events)) r
left join tasks t on t.queue = r.queue and t.id = r.id"""
)
def enqueue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "events").selectExpr(
        "case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end queue", "cast(event_id div 2 + 3000 as string) id", "event_id arrival"
    )
    return enqueue.with_status(requests, tasks(spark, sf_dir), "arrival")


@query(
    """with recursive e as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events),
f as (select user_id, event_type, event_id, ts, rn, true as accepted, ts as held from e where rn = 1
  union all select e.user_id, e.event_type, e.event_id, e.ts, e.rn, e.ts >= f.held + interval 1 hour, case when e.ts >= f.held + interval 1 hour then e.ts else f.held end
  from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.rn = f.rn + 1)
select user_id, event_type, event_id, accepted from f""",
    on_tasks=False,
)
def enqueue_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return enqueue.unique(events, ["user_id", "event_type"], "ts", 3600, "event_id").drop("ts")


# ---- dequeue and outcomes --------------------------------------------------

_LEASED = "'active' as state, $NOW + interval 30 second as lease_expires_at"


def _priorities(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('critical', 6), ('default', 3), ('low', 1), (' ', 9), ('off', 0) as t(queue, priority)")


@query(f"select queue, id, pos, {_LEASED} from (select *, row_number() over (partition by queue order by pos, id) as rn from tasks where state = 'pending') where rn = 1 and queue <> 'low'")
def dequeue_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    paused = spark.sql("select 'low' queue")
    return lifecycle.dequeue(tasks(spark, sf_dir), paused, NOW).select("queue", "id", "pos", "state", "lease_expires_at")


@query(f"select queue, id, pos, {_LEASED} from tasks where state = 'pending' and queue = 'default' order by pos limit 1")
def dequeue_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    paused = spark.sql("select 'critical' queue")
    return lifecycle.dequeue(tasks(spark, sf_dir), paused, NOW, lifecycle.strict_order(_priorities(spark))).select("queue", "id", "pos", "state", "lease_expires_at")


@query()
def dequeue_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.dequeue(tasks(spark, sf_dir), None, NOW, lifecycle.weighted_order(_priorities(spark), 5)).select("queue", "id", "pos", "state")


@query("select queue, id, 'completed' as state, cast(epoch($NOW) as bigint) + retention as expires_at from tasks where state = 'active' and retention > 0")
def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.complete(tasks(spark, sf_dir), NOW).select("queue", "id", "state", "expires_at")


@query("select queue, state, count(*) as n from tasks where not (state = 'active' and pos % 3 = 0) group by 1, 2")
def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    return lifecycle.done(known, known.where("pos % 3 = 0")).groupBy("queue", "state").agg(F.count("*").alias("n"))


@query(
    """select queue, id, 'retry' as state, cast(case when pos % 4 <> 0 then retried + 1 else retried end as integer) as retried,
  cast(epoch($NOW) as bigint) + cast(retried as bigint) ** 4 + 15 + (pos % 30) * (retried + 1) as retry_at from tasks where state = 'active'""".replace("cast(retried as bigint) ** 4", "cast(retried as bigint) * retried * retried * retried")
)
def retry_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retry(tasks(spark, sf_dir), NOW, F.col("pos") % 4 != 0, F.col("pos") % 30).select("queue", "id", "state", "retried", "retry_at")


@query(
    """select queue, id from (select queue, id, row_number() over (partition by queue order by enqueued_at desc, id desc) as rn
  from tasks where state = 'archived' and enqueued_at > $NOW - interval 90 day) where rn <= 99"""
)
def archive_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.archive_trim(tasks(spark, sf_dir), NOW, kept=99).select("queue", "id")


@query(
    """select a.queue, a.id, 'pending' as state, front - row_number() over (partition by a.queue order by a.pos, a.id) as pos
from tasks a join (select queue, min(pos) as front from tasks where state = 'pending' group by 1) f on a.queue = f.queue where a.state = 'active'"""
)
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.requeue(tasks(spark, sf_dir)).select("queue", "id", "state", "pos")


@query("select queue, id, $NOW + interval 30 second as lease_expires_at from tasks where state = 'active' and pos % 2 = 0")
def extend_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    return lifecycle.extend_leases(known, known.where("pos % 2 = 0"), NOW).select("queue", "id", "lease_expires_at")


_ERROR = "case pos % 7 when 0 then 'revoke' when 1 then 'skip_retry' when 2 then 'failed' when 3 then 'timeout' end"
_OUTCOME = f"""select queue, id, case when lease_expires_at < $NOW then 'lease_expired' when error is null then case when pos % 2 = 0 then 'completed' else 'done' end
  when error = 'revoke' then 'done' when error = 'skip_retry' or retried >= retry then 'archived' else 'retry' end as outcome
from (select *, {_ERROR} as error from tasks where state = 'active')"""


@query(_OUTCOME)
def outcome_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = tasks(spark, sf_dir).where("state = 'active'").withColumn("error", F.expr(_ERROR))
    retention = F.when(F.col("pos") % 2 == 0, F.col("retention")).otherwise(0)
    return active.select("queue", "id", lifecycle.outcome(F.col("error"), F.col("retried"), F.col("retry"), retention, F.col("lease_expires_at"), NOW).alias("outcome"))


@query(f"select queue, outcome, count(*) as n from ({_OUTCOME}) group by 1, 2")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_summary(outcome_routing(spark, sf_dir))


@query(
    """select id, case when t > 0 and d > 0 then least(cast(epoch($NOW) as bigint) + t, d) when t > 0 then cast(epoch($NOW) as bigint) + t when d > 0 then d
  else cast(epoch($NOW) as bigint) + 1800 end as deadline
from (select id, cast(pos % 3 * 100 as bigint) as t, cast(case when pos % 2 = 0 then 1705708900 else 0 end as bigint) as d from tasks)"""
)
def task_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    limit = F.when(F.col("pos") % 2 == 0, 1705708900).otherwise(0)
    return known.select("id", lifecycle.deadline((F.col("pos") % 3 * 100).cast("bigint"), limit.cast("bigint"), NOW).alias("deadline"))


@query(
    """with v as (select l_orderkey as k, l_linenumber as line, cast((l_orderkey % 5000) * l_linenumber as hugeint) as n, cast(l_partkey % 30 as hugeint) as j from lineitem),
s as (select *, n * n * n * n + 15 + j * (n + 1) as x from v),
w as (select *, case when x % 18446744073709551616 >= 9223372036854775808 then x % 18446744073709551616 - 18446744073709551616 else x % 18446744073709551616 end as sec from s),
p as (select *, ((sec * 1000000000) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 as y from w)
select k, line, cast(greatest(case when y >= 9223372036854775808 then y - 18446744073709551616 else y end, 0) as bigint) as nanos from p""",
    on_tasks=False,
)
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    retried = (F.col("l_orderkey") % 5000) * F.col("l_linenumber")
    return lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), scalar.backoff_nanos(retried, F.col("l_partkey") % 30).alias("nanos"))


# ---- timers and groups -----------------------------------------------------


@query("select id, case when group_key <> '' then 'aggregating' else 'pending' end as new_state from tasks where state in ('scheduled', 'retry') and process_at <= $NOW")
def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.forward(tasks(spark, sf_dir), NOW).select("id", "new_state")


@query("select queue, id from tasks where state = 'completed' and enqueued_at + to_seconds(retention) <= $NOW")
def expire_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.expire_completed(tasks(spark, sf_dir), NOW).select("queue", "id")


@query("select queue, id from tasks where state = 'active' and lease_expires_at <= $NOW - interval 30 second")
def lease_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.lease_expired(tasks(spark, sf_dir), NOW).select("queue", "id")


@query("select id, case when retried >= retry then 'archived' else 'retry' end as new_state from tasks where state = 'active' and lease_expires_at <= $NOW - interval 30 second")
def recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.recover(tasks(spark, sf_dir), NOW).select("id", "new_state")


_DECISION = """select queue, group_key, count(*) as n, case when count(*) >= 44 then 'size' when min(enqueued_at) <= $NOW - interval 444 hour then 'delay'
  when max(enqueued_at) <= $NOW - interval 8 hour then 'grace' else 'none' end as reason from tasks where state = 'aggregating' group by 1, 2"""
_MEMBERS = f"""select t.queue, t.group_key, t.id, t.payload, cast(rn as integer) as rn, reason from (
  select *, row_number() over (partition by queue, group_key order by enqueued_at, encode(id)) as rn from tasks where state = 'aggregating') t
join ({_DECISION}) d on t.queue = d.queue and t.group_key = d.group_key where reason <> 'none' and rn <= 44"""


@query(_DECISION)
def flush_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.flush_decision(tasks(spark, sf_dir), NOW, **FLUSH)


@query(f"select queue, group_key, id, rn, reason from ({_MEMBERS})")
def flush_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.flush_set(tasks(spark, sf_dir), NOW, **FLUSH).select("queue", "group_key", "id", "rn", "reason")


@query(f"select queue, group_key, count(*) as n, string_agg(payload, chr(10) order by rn) as payload from ({_MEMBERS}) group by 1, 2")
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_aggregate(grouping.flush_set(tasks(spark, sf_dir), NOW, **FLUSH))


@query(f"select queue, group_key, count(*) || ':' || max(id) as payload from ({_MEMBERS}) group by 1, 2")
def group_user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = grouping.flush_set(tasks(spark, sf_dir), NOW, **FLUSH).select("queue", "group_key", "rn", F.col("id").alias("payload"))
    return handlers.aggregate_groups(members, lambda group, ids: f"{len(ids)}:{max(ids)}")


@query("select id, group_key, cast(null as varchar) as set_id from tasks where state = 'aggregating' and enqueued_at + interval 12 hour <= $NOW")
def reclaim_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = tasks(spark, sf_dir).where("state = 'aggregating'").withColumn("set_id", F.lit("s")).withColumn("deadline", F.expr("enqueued_at + interval '12' hour"))
    return grouping.reclaim(sets, NOW).select("id", "group_key", "set_id")


# ---- admin -----------------------------------------------------------------

_WANTED = "select case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end as queue, cast(event_id + case when event_id % 10 = 0 then 10000000 else 0 end as {string}) as id from {events} where event_id % 5 = 0"


def _change(name: str, change: Callable[[DataFrame, DataFrame], DataFrame], sql_code: str, to: str) -> None:
    sql = f"""select queue, id, result, case when result = 1 then '{to}' else state end as new_state
from (select w.queue, w.id, t.state, {sql_code} as result
  from ({_WANTED.format(string="varchar", events="events")}) w left join tasks t on t.queue = w.queue and t.id = w.id)"""

    def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = spark.sql(_WANTED.format(string="string", events="{events}"), events=read(spark, sf_dir, "events"))
        return change(tasks(spark, sf_dir), wanted)

    changed.__name__ = name
    query(sql)(changed)


# each in the order in which the original script tests a task's state
_change("run_task", admin.run_task, "case when t.state is null then 0 when t.state = 'active' then -1 when t.state = 'pending' then -2 else 1 end", "pending")
_change("archive_task", admin.archive_task, "case when t.state is null then 0 when t.state = 'active' then -2 when t.state = 'archived' then -1 else 1 end", "archived")
_change("delete_task", admin.delete_task, "case when t.state is null then 0 when t.state = 'active' then -1 else 1 end", "deleted")


@query("select queue, id, state, 'new-' || id as payload from tasks where state = 'scheduled' and pos % 3 = 0")
def update_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    wanted = known.where("pos % 3 = 0").select("queue", "id", F.concat(F.lit("new-"), "id").alias("new_payload"))
    return admin.update_payload(known, wanted).select("queue", "id", "state", "payload")


def _run_all(name: str, states: tuple[str, ...], group: str | None = None) -> None:
    where = f"state in ({', '.join(repr(s) for s in states)})" + (f" and group_key = '{group}'" if group else "")
    sql = f"""select t.queue, t.id, 'pending' as state, coalesce(last, 0) + row_number() over (partition by t.queue order by t.pos, t.id) as pos
from tasks t left join (select queue, max(pos) as last from tasks where state = 'pending' group by 1) l on l.queue = t.queue where {where}"""

    def ran(spark: SparkSession, sf_dir: str) -> DataFrame:
        return admin.run_all(tasks(spark, sf_dir), states, group).select("queue", "id", "state", "pos")

    ran.__name__ = name
    query(sql)(ran)


_run_all("run_all", ("scheduled", "retry", "archived"))
_run_all("run_aggregating", ("aggregating",), "g3")


def _archive_all(name: str, states: tuple[str, ...], group: str | None = None) -> None:
    where = f"state in ({', '.join(repr(s) for s in states)})" + (f" and group_key = '{group}'" if group else "")
    sql = f"""select queue, id, moved from (select *, row_number() over (partition by queue order by moved desc, enqueued_at desc, id desc) as rn from (
  select *, 0 as moved from tasks where state = 'archived' union all select *, 1 from tasks where {where})) where rn <= 200"""

    def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
        return admin.archive_all(tasks(spark, sf_dir), states, group, kept=200).select("queue", "id", "moved")

    archived.__name__ = name
    query(sql)(archived)


_archive_all("archive_all", ("scheduled", "retry"))
_archive_all("archive_all_pending", ("pending",))
_archive_all("archive_aggregating", ("aggregating",), "g3")


def _delete_all(name: str, states: tuple[str, ...], group: str | None = None) -> None:
    where = f"state in ({', '.join(repr(s) for s in states)})" + (f" and group_key = '{group}'" if group else "")
    sql = f"select queue, state, count(*) as deleted, state not in ('pending', 'aggregating') as releases_locks from tasks where {where} group by 1, 2"

    def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return admin.delete_all(tasks(spark, sf_dir), states, group)

    deleted.__name__ = name
    query(sql)(deleted)


_delete_all("delete_all", ("scheduled", "retry", "archived", "completed"))
_delete_all("delete_all_pending", ("pending",))
_delete_all("delete_aggregating", ("aggregating",), "g3")


@query("select queue, case when queue = 'low' then timestamp '2024-01-01 00:00:00' when queue = 'default' then $NOW end as paused_at, case queue when 'low' then 0 when 'default' then 1 end as result from (select distinct queue from tasks)")
def pause_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = tasks(spark, sf_dir).select("queue").distinct().withColumn("paused_at", F.expr("case when queue = 'low' then timestamp_ntz '2024-01-01 00:00:00' end"))
    return admin.pause(queues, ["low", "default"], scalar.now_of(NOW))


@query("select queue, cast(null as timestamp) as paused_at, case queue when 'low' then 1 when 'default' then 0 end as result from (select distinct queue from tasks)")
def unpause_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = tasks(spark, sf_dir).select("queue").distinct().withColumn("paused_at", F.expr("case when queue = 'low' then timestamp_ntz '2024-01-01 00:00:00' end"))
    return admin.unpause(queues, ["low", "default"])


@query(
    """select queue, case when count(*) filter (state in ('pending', 'active', 'scheduled', 'retry', 'archived')) = 0 then 1 else -1 end as result,
  case when count(*) filter (state = 'active') = 0 then 1 else -2 end as forced from (select * from tasks where queue <> 'low' or state not in ('active')) group by queue"""
)
def delete_queue_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir).where("queue <> 'low' or state <> 'active'")
    return admin.delete_queue(known).join(admin.delete_queue(known, force=True).withColumnRenamed("result", "forced"), "queue")


@query(
    """select count(*) as n from (select distinct 'q:{' || queue || '}:unique:' || type || ':' || md5(payload) as key, id from tasks) l
where not exists (select 1 from tasks e where e.id = l.id and e.state = 'completed')"""
)
def lock_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = tasks(spark, sf_dir).withColumn("unique_key", scalar.unique_key(F.col("queue"), F.col("type"), F.col("payload")))
    locks = keyed.select(F.col("unique_key").alias("key"), F.col("id").alias("owner_id")).distinct()
    return admin.release_locks(locks, keyed.where("state = 'completed'")).agg(F.count("*").alias("n"))


# ---- schedules, routing, functions -----------------------------------------


@query(
    """select entry_id, seconds, tick, cast(entry_id as varchar) || ':' || cast(cast(epoch(tick) as bigint) as varchar) as task_id
from (select s_suppkey as entry_id, s_suppkey % 5 * 3600 + 1800 as seconds, unnest(generate_series(timestamp '2024-01-19 00:00:00' + to_seconds(s_suppkey % 5 * 3600 + 1800), $NOW, to_seconds(s_suppkey % 5 * 3600 + 1800))) as tick from supplier)""",
    on_tasks=False,
)
def interval_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "supplier").selectExpr("s_suppkey entry_id", "s_suppkey % 5 * 3600 + 1800 seconds")
    return schedule.interval_ticks(entries, scalar.now_of("2024-01-19 00:00:00"), scalar.now_of(NOW))


@query(
    """select entry_id, cast(entry_id as varchar) || ':' || cast(cast(epoch(next_at) as bigint) as varchar) as task_id, $NOW + to_seconds(60) as next_at
from (select event_id as entry_id, date_trunc('second', ts) as next_at from events) where next_at <= $NOW""",
    on_tasks=False,
)
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("next_at"), F.lit(60).alias("seconds"))
    return schedule.due(entries, scalar.now_of(NOW)).select("entry_id", "task_id", "next_at")


_SPECS = {
    0: "concat('*/', 5 + s_suppkey % 4 * 5, ' * * * *')", 1: "concat('CRON_TZ=Asia/Tokyo ', s_suppkey % 60, ' 9 * * *')", 2: "concat('  ?/15 ', s_suppkey % 24, '-23/5 * * *')", 3: "'@daily'",
    4: "'0 0 9,15 * mon'", 5: "'* * * * * *'", 6: "concat('TZ=America/New_York 30 ', s_suppkey % 24, ' * mar *')", 7: "concat('0 12 ', 1 + s_suppkey % 28, ' jan-mar/2 ?')",
}
_CRON_FROM, _CRON_TO = "2024-03-08 06:00:00", "2024-03-12 06:00:00"


@query(
    f"""with m as (select unnest(generate_series(timestamp '{_CRON_FROM}' + interval 1 minute, timestamp '{_CRON_TO}', interval 1 minute)) as t),
z as (select t, t + interval 9 hour as tokyo, case when t >= timestamp '2024-03-10 07:00:00' then t - interval 4 hour else t - interval 5 hour end as york, hour(t) as h, minute(t) as mi, day(t) as d from m),
s as (select s_suppkey as k, case s_suppkey % 8 {" ".join(f"when {k} then {v}" for k, v in _SPECS.items())} end as spec from supplier)
select k as entry_id, spec, t as tick, null as error from s join z on case k % 8 when 0 then mi % (5 + k % 4 * 5) = 0 when 1 then hour(tokyo) = 9 and minute(tokyo) = k % 60
  when 2 then mi % 15 = 0 and h >= k % 24 and (h - k % 24) % 5 = 0 when 3 then h = 0 and mi = 0 when 4 then h = 0 and mi = 0 and (d in (9, 15) or dayofweek(t) = 1)
  when 6 then minute(york) = 30 and hour(york) = k % 24 when 7 then h = 12 and mi = 0 and d = 1 + k % 28 else false end
union all select k, spec, null, '6 fields, not 5' from s where k % 8 = 5""",
    on_tasks=False,
)
def cron_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.cron_ticks(_specs(spark, sf_dir), _CRON_FROM, _CRON_TO)


@query(
    f"""with m as (select unnest(generate_series(timestamp '{_CRON_FROM}' + interval 1 minute, timestamp '{_CRON_FROM}' + interval 33 day, interval 1 minute)) as t),
z as (select t, t + interval 9 hour as tokyo, case when t >= timestamp '2024-03-10 07:00:00' then t - interval 4 hour else t - interval 5 hour end as york, hour(t) as h, minute(t) as mi, day(t) as d from m),
s as (select s_suppkey as k, case s_suppkey % 8 {" ".join(f"when {k} then {v}" for k, v in _SPECS.items())} end as spec from supplier),
f as (select k, min(t) as next_at from s join z on case k % 8 when 0 then mi % (5 + k % 4 * 5) = 0 when 1 then hour(tokyo) = 9 and minute(tokyo) = k % 60
  when 2 then mi % 15 = 0 and h >= k % 24 and (h - k % 24) % 5 = 0 when 3 then h = 0 and mi = 0 when 4 then h = 0 and mi = 0 and (d in (9, 15) or dayofweek(t) = 1)
  when 6 then minute(york) = 30 and hour(york) = k % 24 else false end group by k
  union all select k, min(t) from s join (select unnest(generate_series(timestamp '{_CRON_FROM}' + interval 6 hour, timestamp '{_CRON_FROM}' + interval 366 day, interval 1 day)) as t) n
    on k % 8 = 7 and month(t) in (1, 3) and day(t) = 1 + k % 28 group by k)
select s.k as entry_id, spec, next_at from s left join f on f.k = s.k""",
    on_tasks=False,
)
def cron_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.cron_next(_specs(spark, sf_dir), _CRON_FROM)


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = " ".join(f"when {k} then {v}" for k, v in _SPECS.items())
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey entry_id", f"case s_suppkey % 8 {cases} end spec")


@query(
    """select spec, type, case when max(r) = 0 then 'added' when max(d) = 0 then 'stale' else 'unchanged' end as change
from (select 'every ' || (user_id % 50) as spec, event_type as type, 1 as d, 0 as r from events where event_id % 3 = 0
  union all select 'every ' || (user_id % 50), event_type, 0, 1 from events where event_id % 3 = 1 and user_id % 7 <> 0) group by 1, 2""",
    on_tasks=False,
)
def periodic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "events").withColumn("spec", F.concat(F.lit("every "), (F.col("user_id") % 50).cast("string"))).withColumnRenamed("event_type", "type")
    return schedule.periodic_diff(entries.where("event_id % 3 = 0"), entries.where("event_id % 3 = 1 and user_id % 7 <> 0"), ["spec", "type"])


@query("select id, type, case when type = 'event:click' then 'event:click' when type like 'event:s%' then 'event:s' when type like 'event:p%' then 'event:' else 'event:' end as pattern from tasks")
def mux_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.sql("select * from values ('event:'), ('event:s'), ('event:click'), ('other') as t(pattern)")
    return handlers.route(tasks(spark, sf_dir), patterns).select("id", "type", "pattern")


@query(
    """select outcome, count(*) as n from (select case when type = 'event:click' then 'ok' when type = 'event:error' then 'skip_retry' when type = 'event:view' then 'failed' else 'not found' end as outcome from tasks) group by 1"""
)
def handler_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mux = handlers.Mux()

    def skip(payload: str | None) -> None:
        raise handlers.TaskError("bad payload", "skip_retry")

    def fail(payload: str | None) -> None:
        raise ValueError("handler failed")

    mux.handle("event:click", lambda payload: payload)
    mux.handle("event:error", skip)
    mux.handle("event:view", fail)
    outcome = F.when(F.col("ok"), "ok").when(F.col("message").startswith("handler not found"), "not found").otherwise(F.col("error"))
    return mux.run(tasks(spark, sf_dir)).select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("select id, 'q:{' || queue || '}:unique:' || type || ':' || md5(payload) as k from tasks")
def unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("id", scalar.unique_key(F.col("queue"), F.col("type"), F.col("payload")).alias("k"))


@query("select id, 'q:{' || queue || '}:processed:' || strftime(enqueued_at, '%Y-%m-%d') as k, cast(floor(epoch(enqueued_at)) as bigint) as seconds, epoch_us(enqueued_at) * 1000 as nanos from tasks")
def utc_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("enqueued_at").cast("timestamp"), "yyyy-MM-dd")
    return tasks(spark, sf_dir).select(
        "id", F.concat(scalar.queue_key(F.col("queue"), "processed:"), day).alias("k"), scalar.epoch(F.col("enqueued_at")).alias("seconds"), scalar.epoch_nanos(F.col("enqueued_at")).alias("nanos")
    )


@query(
    """select k, case when s >= 3600 then (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm' || (s % 60) || 's' else s || 's' end as shown, cast(s as double) as seconds
from (select o_orderkey as k, o_orderkey % 9000 as s from orders)""",
    on_tasks=False,
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = scalar.format_seconds(F.col("o_orderkey") % 9000)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), shown.alias("shown"), scalar.duration_seconds(shown).alias("seconds"))


@query(
    """select id, 'Queue("' || queue || '"), MaxRetry(' || retry || '), Timeout(30m0s)' || case when group_key <> '' then ', Group("' || group_key || '")' else '' end as options from tasks"""
)
def option_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("group_key") != "", F.col("group_key"))
    options = scalar.option_strings(F.col("queue"), F.col("retry"), F.lit(1800), F.lit(None).cast("int"), group)
    return tasks(spark, sf_dir).select("id", F.array_join(options, ", ").alias("options"))


@query("select id, cast(json_extract(payload, '$.k') as bigint) as k from tasks")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("id", F.from_json("payload", "k bigint")["k"].alias("k"))


# ---- unique enqueue, recovery and texts in full ------------------------------


@query(
    """, e as (select case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end as queue, cast(event_id // 2 + 3000 as varchar) as id,
    user_id, event_type, event_id, event_id * 7919 % 1000003 as tie, cast(date_trunc('hour', ts) as timestamp) as ts, 600 + event_id % 5 * 1800 as ttl,
    row_number() over (partition by user_id, event_type order by date_trunc('hour', ts), event_id * 7919 % 1000003) as rn from events),
f as (select *, true as free, ts + to_seconds(ttl) as until from e where rn = 1
  union all select e.*, e.ts >= f.until, case when e.ts >= f.until then e.ts + to_seconds(e.ttl) else f.until end
  from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.rn = f.rn + 1),
n as (select *, row_number() over (partition by queue, id, free order by ts, tie) as nth from f)
select n.event_id, n.queue, n.id, case when not free then -1 when nth = 1 and t.id is null then 1 else 0 end as status
from n left join tasks t on t.queue = n.queue and t.id = n.id"""
)
def enqueue_unique_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "events").selectExpr(
        "case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end queue", "cast(event_id div 2 + 3000 as string) id",
        "user_id", "event_type", "event_id", "event_id * 7919 % 1000003 tie", "cast(date_trunc('hour', ts) as timestamp_ntz) ts", "600 + event_id % 5 * 1800 ttl",
    )
    found = enqueue.unique_status(requests, tasks(spark, sf_dir), ["user_id", "event_type"], "ts", "ttl", "tie")
    return found.select("event_id", "queue", "id", "status")


ORACLE_SQL["enqueue_unique_status"] = ORACLE_SQL["enqueue_unique_status"].replace("with tasks", "with recursive tasks", 1)

_RECOVERED = """select queue, id, retried >= retry as over, case when retried >= retry then 'archived' else 'retry' end as new_state,
  case when retried < retry then cast(epoch($NOW) as bigint) + retried ** 4 + 15 + pos % 30 * (retried + 1) end as retry_at,
  case when retried < retry then retried + 1 else retried end as retried, 'task lease expired' as error, cast(epoch($NOW) as bigint) as last_failed_at
from tasks where state = 'active' and lease_expires_at <= $NOW - interval 30 second"""


@query(f"select queue, id, new_state, cast(retry_at as bigint) as retry_at, retried, error, last_failed_at from ({_RECOVERED})")
def recover_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timers.recover_fully(tasks(spark, sf_dir), NOW, F.col("pos") % 30)
    return found.select("queue", "id", "new_state", "retry_at", "retried", "error", "last_failed_at")


@query(f"select queue, count(*) filter (not over) as retried, count(*) filter (over) as archived, count(*) as total from ({_RECOVERED}) group by queue")
def recover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.recover_result(timers.recover_fully(tasks(spark, sf_dir), NOW, F.col("pos") % 30))


@query(
    """with s as (select o_orderkey as k, cast(o_orderkey * 7919 % 86413 * cast(10 ** (o_orderkey % 9) as bigint) as bigint) as n from orders),
p as (select *, n // 3600000000000 as h, n // 60000000000 % 60 as m, n // 1000000000 as t, n % 1000000000 as f from s)
select k, n, case when n = 0 then '0s' when t = 0 and n >= 1000000 then rtrim(rtrim(printf('%.6f', n / 1000000.0), '0'), '.') || 'ms'
  when t = 0 and n >= 1000 then rtrim(rtrim(printf('%.3f', n / 1000.0), '0'), '.') || 'µs' when t = 0 then n || 'ns'
  else case when h > 0 then h || 'h' else '' end || case when h > 0 or m > 0 then m || 'm' else '' end || (t % 60) ||
    case when f > 0 then '.' || rtrim(lpad(cast(f as varchar), 9, '0'), '0') else '' end || 's' end as shown,
  n as parsed, greatest(n // 1000000000, 1) as every from p""",
    on_tasks=False,
)
def spans_in_nanoseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_orderkey * 7919 % 86413 * cast(power(10, o_orderkey % 9) as bigint) n")
    shown = spans.withColumn("shown", scalar.format_nanos(F.col("n")))
    return shown.select("k", "n", "shown", scalar.duration_nanos(F.col("shown")).alias("parsed"), scalar.every_seconds(F.concat(F.lit("@every "), "shown")).alias("every"))


@query(
    """select id, 'Queue("' || queue || '"), TaskID("' || id || '"), MaxRetry(' || retry || '), Timeout(30m0s), Deadline(' || d || '), Unique(1.5s), ProcessAt(' || d || '), ProcessIn(2ms), Retention(1h0m0s)'
  || case when group_key <> '' then ', Group("' || group_key || '")' else '' end as options
from (select *, strftime(lease_expires_at, '%a %b ') || lpad(cast(day(lease_expires_at) as varchar), 2, ' ') || strftime(lease_expires_at, ' %H:%M:%S UTC %Y') as d from tasks)"""
)
def option_texts_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("lease_expires_at")
    options = {
        "Queue": F.col("queue"), "TaskID": F.col("id"), "MaxRetry": F.col("retry"), "Timeout": F.lit(1800 * 10**9), "Deadline": at, "Unique": F.lit(1_500_000_000), "ProcessAt": at,
        "ProcessIn": F.lit(2_000_000), "Retention": F.col("retention") * 10**9, "Group": F.when(F.col("group_key") != "", F.col("group_key")),
    }
    return tasks(spark, sf_dir).select("id", F.array_join(scalar.all_option_strings(options), ", ").alias("options"))
