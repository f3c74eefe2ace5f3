"""Registered queries of ordered folds: locks from request to release, sets over a table of checks, leases from heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideq.operators import enqueue, grouping, leases
from tideq.plans.registry import query
from tideq.sources.tables import read, tasks

_QUEUE = "case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end"
#: Requests whose tie disagrees with the order of their ids; some scheduled, some grouped, some wrong, some without a lock.
_ASKED = """select event_id, {queue} as queue, case when event_id % 40 = 3 then ' ' else event_type end as type, cast(event_id {div} 2 + 3000 as {string}) as id,
  cast(user_id % 20 as {string}) as payload, {minute} as moment, event_id * 7919 % 1000003 as tie, cast(null as int) as max_retries, cast(0 as bigint) as timeout,
  cast(0 as bigint) as deadline, case when event_id % 4 = 0 then ts + interval '30' minute end as process_at, cast(null as int) as process_in,
  case when event_id % 8 = 1 then 'g1' end as group_key, cast(case when event_id % 7 = 0 then null when event_id % 41 = 0 then 0 else 600 + event_id % 5 * 1800 end as bigint) as unique_for,
  cast(event_id % 3 * 60 as bigint) as retain_for from {events}"""
_ENDED = """select {queue} as queue, event_type as type, cast(event_id {div} 2 + 3000 as {string}) as id, cast(user_id % 20 as {string}) as payload,
  {minute} + interval '5' minute as moment from {events} where event_id % 3 = 0"""
_DUCK = {"queue": _QUEUE, "div": "//", "string": "varchar", "minute": "date_trunc('hour', ts)", "events": "events"}
_SPARK = _DUCK | {"div": "div", "string": "string", "minute": "cast(date_trunc('hour', ts) as timestamp_ntz)", "events": "{events}"}


@query(
    f""", asked as ({_ASKED.format(**_DUCK)}), ended as ({_ENDED.format(**_DUCK)}),
p as (select *, case when trim(type) = '' then 'blank type' when unique_for < 1 then 'unique time below a second' end as error,
  case when process_at > moment then 'scheduled' when group_key is not null then 'aggregating' else 'pending' end as planned,
  case when process_at > moment then cast(floor(epoch(process_at)) as bigint) + unique_for - cast(floor(epoch(moment)) as bigint) else unique_for end as seconds,
  'q:{{' || queue || '}}:unique:' || type || ':' || md5(payload) as key from asked),
rows as (select key, moment, 0 as is_end, tie, event_id, id, seconds from p where error is null
  union all select 'q:{{' || queue || '}}:unique:' || type || ':' || md5(payload), moment, 1, null, null, id, null from ended),
e as (select *, row_number() over (partition by key order by moment, is_end desc, tie, id) as rn from rows),
f as (select *, is_end = 1 or seconds is null or true as open, case when is_end = 0 and seconds is not null then moment + to_seconds(seconds) else moment end as until,
    case when is_end = 0 and seconds is not null then id end as owner from e where rn = 1
  union all select e.*, e.is_end = 1 or e.seconds is null or e.moment >= f.until,
    case when e.is_end = 1 then case when e.moment < f.until and e.id = f.owner then e.moment else f.until end
      when e.seconds is not null and e.moment >= f.until then e.moment + to_seconds(e.seconds) else f.until end,
    case when e.is_end = 0 and e.seconds is not null and e.moment >= f.until then e.id else f.owner end
  from f join e on e.key = f.key and e.rn = f.rn + 1),
n as (select f.event_id, f.open, row_number() over (partition by p.queue, p.id, f.open order by p.moment, p.tie) as nth from f join p on p.event_id = f.event_id)
select p.event_id, p.queue, p.id, p.error, case when p.error is null then p.planned end as state, p.seconds as lock_seconds, p.retain_for as retention,
  case when p.error is not null then null when not n.open then -1 when n.nth = 1 and t.id is null then 1 else 0 end as status
from p left join n on n.event_id = p.event_id left join tasks t on t.queue = p.queue and t.id = p.id""",
    recursive=True,
)
def lock_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    asked, ended = (spark.sql(text.format(**_SPARK), events=events) for text in (_ASKED, _ENDED))
    # beyond a million events several share a tie: their ids decide, and each keeps its own event_id
    found = enqueue.admit(asked, tasks(spark, sf_dir), "moment", ["tie", "id"], ended, carry=("event_id",))
    return found.select("event_id", "queue", "id", "error", "state", "lock_seconds", "retention", "status")


#: Checks of a queue: one of fifty events, at its time.
_CHECKS = f"select {_QUEUE} as queue, ts as at from {{events}} where event_id % 50 = 0"
_SETS = f""", c as (select *, row_number() over (partition by queue order by moment) as k from (select distinct {_QUEUE} as queue, ts as moment from events where event_id % 50 = 0)),
m as (select queue, group_key, id, payload, enqueued_at, row_number() over (partition by queue, group_key order by enqueued_at, encode(id)) as rn from tasks where state = 'aggregating'),
v as (select g.queue, g.group_key, c.k, c.moment, count(m.id) as seen, max(m.enqueued_at) as newest
  from (select distinct queue, group_key from m) g join c on c.queue = g.queue left join m on m.queue = g.queue and m.group_key = g.group_key and m.enqueued_at <= c.moment group by 1, 2, 3, 4),
r as (select queue, group_key, cast(0 as bigint) as k, cast(0 as bigint) as gone, cast(0 as bigint) as took, cast(null as varchar) as reason, cast(null as timestamp) as moment from (select distinct queue, group_key from m)
  union all
  select queue, group_key, k, gone + case when why <> 'none' then least(open, 6) else 0 end, case when why <> 'none' then least(open, 6) else 0 end, why, moment from (
    select v.queue, v.group_key, v.k, r.gone, v.seen - r.gone as open, v.moment,
      case when v.seen - r.gone = 0 then 'none' when v.seen - r.gone >= 6 then 'size' when o.enqueued_at <= v.moment - interval 60 hour then 'delay'
        when v.newest <= v.moment - interval 20 hour then 'grace' else 'none' end as why
    from r join v on v.queue = r.queue and v.group_key = r.group_key and v.k = r.k + 1
    left join m o on o.queue = r.queue and o.group_key = r.group_key and o.rn = r.gone + 1)),
s as (select *, row_number() over (partition by queue, group_key order by k) as set_no from r where took > 0),
closed as (select m.queue, m.group_key, m.id, m.payload, m.enqueued_at, s.set_no, cast(m.rn - s.gone + s.took as integer) as rn, s.reason, s.moment as check_at, s.moment + interval 120 second as deadline
  from s join m on m.queue = s.queue and m.group_key = s.group_key and m.rn > s.gone - s.took and m.rn <= s.gone)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = spark.sql(_CHECKS, events=read(spark, sf_dir, "events")).distinct()
    members = tasks(spark, sf_dir).where("state = 'aggregating'").select("queue", "group_key", "id", "enqueued_at")
    return grouping.sets_at_checks(members, checks, 6, 60 * 3600, 20 * 3600)


@query(f"{_SETS} select queue, group_key, id, set_no, rn, reason, check_at, deadline from closed", recursive=True)
def check_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).drop("enqueued_at")


_SPENT = "check_at + interval '1' second * (set_no * 37 % 150)"
_RUN = f"{_SETS}, done as (select *, {_SPENT} as finished_at from closed)"


@query(
    f"""{_RUN} select queue, group_key, set_no, queue || ':' || group_key || ':' || set_no as id, 'pending' as state, count(*) as n, string_agg(payload, chr(10) order by rn) as payload, max(finished_at) as added_at
from done where finished_at < deadline group by 1, 2, 3""",
    recursive=True,
)
def run_group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.run_sets(_finished(spark, sf_dir), "finished_at")[0]


@query(f"{_RUN} select queue, group_key, id, enqueued_at, deadline as reclaimed_at from done where finished_at >= deadline", recursive=True)
def reclaimed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.run_sets(_finished(spark, sf_dir), "finished_at")[1]


def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = F.make_interval(secs=F.pmod(F.col("set_no") * 37, F.lit(150)))
    payloads = tasks(spark, sf_dir).where("state = 'aggregating'").select("queue", "id", "payload")
    return _sets(spark, sf_dir).withColumn("finished_at", F.col("check_at") + spent).join(payloads, ["queue", "id"])


_BEATS = """select user_id as task_id, ts as at, event_id as tie, case when event_type = 'purchase' then 'start' when event_type = 'signup' then 'end' else 'beat' end as kind,
  cast(3600 * (1 + event_id % 40) as bigint) as lease from {events}"""
_RUNS = """with b as (select user_id as task_id, ts as moment, event_id as tie, event_type = 'purchase' as starts, ts + to_seconds(3600 * (1 + event_id % 40)) as until from events where event_type <> 'signup'),
r as (select *, count(*) filter (starts) over (partition by task_id order by moment, tie) as run from b),
h as (select *, max(until) over (partition by task_id, run order by moment, tie rows between unbounded preceding and 1 preceding) as held from r where run > 0),
k as (select *, coalesce(sum(case when moment >= held + interval 7200 second then 1 else 0 end) over (partition by task_id, run order by moment, tie), 0) as lost from h),
g as (select task_id, run, min(moment) as started_at, max(until) filter (lost = 0) as leased_until, count(*) filter (lost = 0) - 1 as extended, count(*) filter (lost > 0) as refused from k group by 1, 2),
n as (select *, lead(started_at) over (partition by task_id order by run) as next_at from g)"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    beats = spark.sql(_BEATS, events=read(spark, sf_dir, "events")).where("kind <> 'end'")
    return leases.lease_spans(beats, grace=7200)


@query(f"{_RUNS} select task_id, run, started_at, leased_until, extended, refused from n", on_tasks=False)
def lease_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)[0]


@query(
    f"""{_RUNS} select task_id, run, held as gap_from, moment as gap_to, false as lost from k where lost = 0 and moment > held
union all select task_id, run, leased_until, next_at, coalesce(next_at >= leased_until + interval 7200 second, true) from n where next_at is null or next_at > leased_until""",
    on_tasks=False,
)
def lease_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)[1]


@query(
    """select task_id, started_at from (select user_id as task_id, ts as started_at, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events where event_type in ('purchase', 'signup')) where rn = 1 and event_type = 'purchase'""",
    on_tasks=False,
)
def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = spark.sql(_BEATS, events=read(spark, sf_dir, "events"))
    return leases.active_workers(beats).select("task_id", F.col("at").alias("started_at"))


@query(
    """select user_id as task_id, ts as moment, 'start' as kind from events
union all select user_id, unnest(generate_series(ts + to_seconds(40), ts + to_seconds(user_id % 5 * 40 + event_id % 2) - interval 1 microsecond, to_seconds(40))), 'beat' from events
""",
    on_tasks=False,
)
def lease_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_interval(secs=F.col("user_id") % 5 * 40 + F.col("event_id") % 2)).alias("ended_at"))
    return leases.extensions(runs, "every", 40).withColumnRenamed("at", "moment")
