"""Registered queries of counters, write-back, typed handlers, registrations and value functions, compared row by row."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideq.functions import scalar
from tideq.operators import admin, counters, grouping, handlers, inspect, lifecycle, presence, schedule, timers
from tideq.plans import ordered
from tideq.plans.registry import outcome_routing, query
from tideq.sources import snapshots
from tideq.sources.tables import NOW, read, tasks
from tideq.streaming.runs import shared_folder

#: Days kept, scaled so that some expire on the test tables.
_DAYS = 10
_COUNTED = "count(*) filter (state in ('completed', 'retry', 'archived')) as processed, count(*) filter (state in ('retry', 'archived')) as failed"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters of three batches, merged one after the other."""
    known = tasks(spark, sf_dir)
    first, second, third = (counters.counted(known.where(f"pos % 3 = {k}")) for k in range(3))
    return counters.merged(counters.merged(first, second), third)


@query(f"select * from (select queue, cast(enqueued_at as date) as day, {_COUNTED} from tasks group by 1, 2) where processed > 0 and day > date '2024-01-20' - {_DAYS}")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.unexpired(_daily(spark, sf_dir), NOW, _DAYS)


@query(f"select queue, {_COUNTED} from tasks group by queue")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.totals(_daily(spark, sf_dir))


_PER_STATE = ", ".join(f"count(*) filter (state = '{s}') as {s}" for s in scalar.STATES)


@query(
    f"""select q.queue, q.queue in ('low', 'empty') as paused, oldest_pending, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("size", *scalar.STATES, "groups", "latency", "processed_today", "failed_today", "processed_total", "failed_total"))}
from (select distinct queue from tasks union select 'empty') q
left join (select queue, count(*) as size, {_PER_STATE}, count(distinct group_key) filter (state = 'aggregating') as groups, arg_min(enqueued_at, pos) filter (state = 'pending') as oldest_pending,
  greatest(cast(floor(epoch($NOW) - floor(epoch(arg_min(enqueued_at, pos) filter (state = 'pending')))) as bigint), 0) as latency from tasks group by queue) s on s.queue = q.queue
left join (select queue, count(*) filter (state in ('completed', 'retry', 'archived')) as processed_today, count(*) filter (state in ('retry', 'archived')) as failed_today
  from tasks where cast(enqueued_at as date) = date '2024-01-19' group by queue) d on d.queue = q.queue
left join (select queue, count(*) filter (state in ('completed', 'retry', 'archived')) as processed_total, count(*) filter (state in ('retry', 'archived')) as failed_total from tasks group by queue) t on t.queue = q.queue"""
)
def queue_stats_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the clock, with the counters of the day before, the last whole day of the table."""
    daily = _daily(spark, sf_dir)
    yesterday = daily.where("day = date '2024-01-19'").withColumn("day", F.lit("2024-01-20").cast("date"))
    return counters.stats_in_full(tasks(spark, sf_dir), yesterday, counters.totals(daily), spark.sql("select 'low' queue union all select 'empty'"), NOW)


@query(
    """select queue, id, pos, type, case when state = 'scheduled' and pos % 3 = 0 then 'new-' || id else payload end as payload,
  case when state = 'active' and retried >= retry then 'archived' when state = 'active' and pos % 2 = 0 then 'completed' else state end as state,
  case when state = 'active' and retried < retry and pos % 2 = 0 then 'result of ' || id end as result
from tasks where not (state = 'archived' and pos % 5 = 0) union all select 'new', 'n' || pos, pos, type, payload, 'pending', null from tasks where state = 'retry'"""
)
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes, results, payloads, deletions and new tasks written into a snapshot, and read back."""
    known = tasks(spark, sf_dir).select("queue", "id", "pos", "type", "payload", "state", "retried", "retry").withColumn("result", F.lit(None).cast("string"))
    folder = f"{shared_folder(spark)}/snapshot-{uuid4()}"
    snapshots.create(known, f"{folder}/tasks", 4)
    ended = known.where("state = 'active' and (retried >= retry or pos % 2 = 0)")
    over = F.col("retried") >= F.col("retry")
    ended = ended.withColumn("state", F.when(over, "archived").otherwise("completed")).withColumn("result", F.when(~over, F.concat(F.lit("result of "), "id")))
    paid = known.where("state = 'scheduled' and pos % 3 = 0").withColumn("payload", F.concat(F.lit("new-"), "id"))
    gone = known.where("state = 'archived' and pos % 5 = 0").withColumn("deleted", F.lit(True))
    added = known.where("state = 'retry'").withColumn("queue", F.lit("new")).withColumn("id", F.concat(F.lit("n"), F.col("pos").cast("string"))).withColumn("state", F.lit("pending"))
    for n, changes in enumerate((ended.unionByName(paid), gone.unionByName(added.withColumn("deleted", F.lit(False))))):
        snapshots.upsert(spark, f"{folder}/tasks", changes, 4, f"{folder}/staged-{n}")
    return snapshots.load(spark, f"{folder}/tasks").select("queue", "id", "pos", "type", "payload", "state", "result")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mux = handlers.TypedMux()
    none = F.lit(None).cast("string")
    mux.handle("event:click", "k bigint", lambda p, c: (F.concat_ws(":", (p["k"] * 2).cast("string"), c["id"], c["queue"]), none))
    mux.handle("event:view", "k bigint", lambda p, c: (none, F.when(p["k"] % 3 == 0, "skip_retry").when(c["retried"] >= c["retry"], "out of retries")))
    mux.handle("event:error", "k array<bigint>", lambda p, c: (p["k"].cast("string"), none))
    return mux.run(tasks(spark, sf_dir)).select("id", "type", "queue", "ok", "error", "message", "result")


_HANDLED = """select id, type, queue, error is null as ok, error, message, case when error is null and type = 'event:click' then k * 2 || ':' || id || ':' || queue end as result
from (select *, case when type in ('event:signup', 'event:purchase', 'event:error') then 'failed' when type = 'event:view' and k % 3 = 0 then 'skip_retry' when type = 'event:view' and retried >= retry then 'failed' end as error,
  case when type in ('event:signup', 'event:purchase') then 'handler not found for ' || type when type = 'event:error' then 'failed to decode typed payload for event:error'
    when type = 'event:view' and k % 3 = 0 then 'skip_retry' when type = 'event:view' and retried >= retry then 'out of retries' end as message
  from (select *, cast(json_extract(payload, '$.k') as bigint) as k from tasks))"""


@query(_HANDLED)
def typed_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)


@query(f"select queue, error, message, count(*) as n, min(id) as first_id from ({_HANDLED}) where not ok group by 1, 2, 3")
def error_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handlers.failures(_typed(spark, sf_dir), lambda failed: failed.groupBy("queue", "error", "message").agg(F.count("*").alias("n"), F.min("id").alias("first_id")))


@query("select queue, id, state from tasks where not (state = 'active' and pos % 3 = 0)")
def done_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    return lifecycle.done(known, known.where("pos % 3 = 0")).select("queue", "id", "state")


@query(
    """select id, type = 'event:click' as ok, case when type = 'event:error' then 'skip_retry' when type <> 'event:click' then 'failed' end as error,
  case when type = 'event:error' then 'bad payload' when type = 'event:view' then 'handler failed' when type <> 'event:click' then 'handler not found for ' || type end as message,
  case when type = 'event:click' then '<' || payload || '>' end as result from tasks"""
)
def handler_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mux = handlers.Mux()

    def skip(payload: str | None) -> None:
        raise handlers.TaskError("bad payload", "skip_retry")

    def fail(payload: str | None) -> None:
        raise ValueError("handler failed")

    mux.handle("event:click", lambda payload: payload)
    mux.handle("event:error", skip)
    mux.handle("event:view", fail)
    framed = lambda inner: lambda payload: f"<{inner(payload)}>"
    return mux.run(tasks(spark, sf_dir), (framed,)).select("id", "ok", "error", "message", "result")


@query(
    """select distinct 'q:{' || queue || '}:unique:' || type || ':' || md5(payload) as key, id as owner_id from tasks l
where not exists (select 1 from tasks e where e.id = l.id and e.state = 'completed')"""
)
def locks_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = tasks(spark, sf_dir).withColumn("unique_key", scalar.unique_key(F.col("queue"), F.col("type"), F.col("payload")))
    locks = keyed.select(F.col("unique_key").alias("key"), F.col("id").alias("owner_id")).distinct()
    return admin.release_locks(locks, keyed.where("state = 'completed'"))


@query(
    """select w.queue, w.id, case when t.id is null then 0 when t.state = 'scheduled' then 1 else -1 end as result
from (select case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end as queue, cast(event_id + case when event_id % 10 = 0 then 10000000 else 0 end as varchar) as id from events) w
left join tasks t on t.queue = w.queue and t.id = w.id"""
)
def update_payload_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = "case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end queue"
    wanted = read(spark, sf_dir, "events").selectExpr(queue, "cast(event_id + case when event_id % 10 = 0 then 10000000 else 0 end as string) id")
    return admin.update_payload_codes(tasks(spark, sf_dir), wanted)


@query("select queue, group_key, id, 's' || (pos % 4) as set_id from tasks where state = 'aggregating' and pos % 4 <> 1")
def delete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = tasks(spark, sf_dir).where("state = 'aggregating'").select("queue", "group_key", "id", F.concat(F.lit("s"), (F.col("pos") % 4).cast("string")).alias("set_id"))
    return grouping.delete_sets(sets, sets.where("set_id = 's1'"))


@query(
    """select cast(s_suppkey as varchar) as entry_id, case when s_suppkey % 3 = 0 then '@every 90s' else '@every ' || s_suppkey || 'm' end as spec, case when s_suppkey % 3 = 0 then 90 else s_suppkey * 60 end as seconds
from supplier where s_suppkey % 7 <> 0""",
    on_tasks=False,
)
def registered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) entry_id", "concat('@every ', s_suppkey, 'm') spec")
    key = F.col("entry_id").cast("int")
    changed = schedule.register(entries, entries.where(key % 3 == 0).withColumn("spec", F.lit("@every 90s")))
    return schedule.every_entries(schedule.unregister(changed, entries.where(key % 7 == 0)))


@query(
    """select spec, type, payload, options, case when max(r) = 0 then 'added' when max(d) = 0 then 'stale' else 'unchanged' end as change from (
  select 'every ' || (user_id % 50) as spec, event_type as type, props as payload, case when event_id % 4 = 0 then 'MaxRetry(1),Queue("a")' else 'Queue("a")' end as options, 1 as d, 0 as r from events where event_id % 3 = 0
  union all select 'every ' || (user_id % 50), event_type, props, case when event_id % 4 < 2 then 'MaxRetry(1),Queue("a")' else 'Queue("a")' end, 0, 1 from events where event_id % 3 <> 2) group by 1, 2, 3, 4""",
    on_tasks=False,
)
def periodic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "events").withColumn("spec", F.concat(F.lit("every "), (F.col("user_id") % 50).cast("string")))
    options = lambda held, *order: F.when(held, F.array(*(F.lit(o) for o in order))).otherwise(F.array(F.lit('Queue("a")')))
    key = lambda o: schedule.periodic_key(F.col("spec"), F.col("event_type"), F.col("props"), o).alias("key")
    desired = entries.where("event_id % 3 = 0").select(key(options(F.expr("event_id % 4 = 0"), 'Queue("a")', "MaxRetry(1)")))
    present = entries.where("event_id % 3 <> 2").select(key(options(F.expr("event_id % 4 < 2"), "MaxRetry(1)", 'Queue("a")')))
    found = schedule.periodic_diff(desired, present, ["key"])
    return found.select("key.spec", "key.type", "key.payload", F.array_join("key.options", ",").alias("options"), "change")


@query(
    """select event_id, cast(floor(epoch_us(m) / 1000000.0) as bigint) as seconds, cast((epoch_us(m) - cast(floor(epoch_us(m) / 1000000.0) as bigint) * 1000000) * 1000 as integer) as nanos, m as back,
  cast((epoch_us(m) - epoch_us(ts)) as bigint) * 1000 as apart, event_type in ('active', 'pending', 'scheduled', 'retry', 'archived', 'completed', 'aggregating') as is_state,
  case when event_id % 5 = 0 then null else event_type end as text, case when event_id % 4 <> 0 then make_timestamp(event_id % 4 * 1000000) end as failed_at, greatest(event_id % 7 - 3, 0) as left_over,
  '"' || replace(props, '"', chr(92) || '"') || '"' as quoted
from (select *, ts - to_days(cast(event_id % 40 * 1000 as integer)) as m from events)""",
    on_tasks=False,
)
def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants both ways, differences, states, raw text, optional times and spans, quoting, over the event table."""
    events = read(spark, sf_dir, "events").withColumn("m", F.expr("ts - make_interval(0, 0, 0, cast(event_id % 40 * 1000 as int))"))
    at = scalar.instant_of(F.col("m"))
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.encode("event_type", "utf-8"), F.unhex(F.lit("ff")))).otherwise(F.encode("event_type", "utf-8"))
    return events.select(
        "event_id", at["seconds"].alias("seconds"), at["nanos"].alias("nanos"), scalar.time_of(at).alias("back"), scalar.nanos_between(F.col("m"), F.col("ts")).cast("bigint").alias("apart"),
        scalar.is_state(F.col("event_type")).alias("is_state"), scalar.utf8_or_null(raw).alias("text"), scalar.time_or_null(F.col("event_id") % 4).alias("failed_at"),
        scalar.span_or_zero(F.col("event_id") % 7 - 3).alias("left_over"), scalar.quoted(F.col("props")).alias("quoted"),
    )


_LOST = "state = 'active' and lease_expires_at <= $NOW - interval 30 second"


def _recovery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return timers.recovery(tasks(spark, sf_dir), NOW, F.col("pos") % 30, kept=150)


@query(
    f"""select queue, id, moved from (select *, row_number() over (partition by queue order by moved desc, enqueued_at desc, id desc) as rn from (
  select *, 0 as moved from tasks where state = 'archived' and enqueued_at > $NOW - interval 90 day union all select *, 1 from tasks where {_LOST} and retried >= retry)
  where queue in (select queue from tasks where {_LOST} and retried >= retry)) where rn <= 150"""
)
def recovery_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovery(spark, sf_dir)[1].select("queue", "id", "moved")


@query(f"select queue, date '2024-01-20' as day, count(*) as processed, count(*) as failed from tasks where {_LOST} group by queue")
def recovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovery(spark, sf_dir)[2]


@query(
    f"""select q.queue, a.processed, a.completed, a.done, a.retried, a.lease_expired, a.archived, f.forwarded_pending, f.forwarded_aggregating, r.recovered_retry, r.recovered_archived, e.deleted_expired
from (select distinct queue from tasks) q
join (select queue, count(*) filter (outcome <> 'lease_expired') as processed, count(*) filter (outcome = 'completed') as completed, count(*) filter (outcome = 'done') as done, count(*) filter (outcome = 'retry') as retried,
  count(*) filter (outcome = 'lease_expired') as lease_expired, count(*) filter (outcome = 'archived') as archived from (select queue, case when lease_expires_at < $NOW then 'lease_expired'
    when pos % 7 > 3 then case when pos % 2 = 0 then 'completed' else 'done' end when pos % 7 = 0 then 'done' when pos % 7 = 1 or retried >= retry then 'archived' else 'retry' end as outcome from tasks where state = 'active') group by 1) a on a.queue = q.queue
join (select queue, count(*) filter (group_key = '') as forwarded_pending, count(*) filter (group_key <> '') as forwarded_aggregating from tasks where state in ('scheduled', 'retry') and process_at <= $NOW group by 1) f on f.queue = q.queue
join (select queue, count(*) filter (retried < retry) as recovered_retry, count(*) filter (retried >= retry) as recovered_archived from tasks where {_LOST} group by 1) r on r.queue = q.queue
join (select queue, count(*) as deleted_expired from tasks where state = 'completed' and enqueued_at + to_seconds(retention) <= $NOW group by 1) e on e.queue = q.queue"""
)
def run_summary_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir)
    return lifecycle.run_summary_in_full(outcome_routing(spark, sf_dir), timers.forward(known, NOW), timers.recover(known, NOW), timers.expire_completed(known, NOW))


@query(
    """select id, error, message from (select id, case type when 'event:click' then 'timeout' when 'event:view' then 'cancelled' when 'event:error' then 'failed' end as error,
  case type when 'event:click' then 'context deadline exceeded' when 'event:view' then 'context canceled' when 'event:error' then 'panic: ' || payload end as message from tasks)"""
)
def stopped_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asyncio import CancelledError

    def late(payload: str | None) -> None:
        raise TimeoutError

    def stopped(payload: str | None) -> None:
        raise CancelledError

    def panic(payload: str | None) -> None:
        raise ZeroDivisionError(f"panic: {payload}")

    mux = handlers.Mux()
    for pattern, handler in {"event:click": late, "event:view": stopped, "event:error": panic, "event:": lambda payload: None}.items():
        mux.handle(pattern, handler)
    return mux.run(tasks(spark, sf_dir)).select("id", "error", "message")


@query(
    """select queue, id, type, cast(rn as integer) as rn, result from (select *, row_number() over (partition by queue order by enqueued_at, encode(id)) as rn, case when pos % 4 <> 0 then 'r' || id end as result
  from tasks where state = 'completed') where rn > 30 and rn <= 60"""
)
def list_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tasks(spark, sf_dir).withColumn("result", F.when(F.col("pos") % 4 != 0, F.concat(F.lit("r"), "id")))
    return inspect.list_tasks(stored, "completed", 2, 30).select("queue", "id", "type", "rn", "result")


@query(
    """select user_id % 20 as scheduler_id, event_id as entry_id from events e join (select user_id % 20 as s, max(cast(ts as date)) as last from events group by 1) l on l.s = e.user_id % 20 and cast(e.ts as date) = l.last
where user_id % 20 % 6 <> 0""",
    on_tasks=False,
)
def scheduler_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's report of a scheduler takes the place of its entries before; cleared schedulers have none."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("scheduler_id"), F.col("event_id").alias("entry_id"), F.to_date("ts").alias("day"))
    reports = presence.latest(rows.select("scheduler_id", "day").distinct(), ["scheduler_id"], "day", "day")
    held = rows.join(reports, ["scheduler_id", "day"]).drop("day")
    return presence.without(held, reports.where("scheduler_id % 6 = 0"), ["scheduler_id"])


@query("""select id, '{"id":"' || id || '","k":' || cast(json_extract(payload, '$.k') as bigint) || '}' as encoded, cast(json_extract(payload, '$.k') as bigint) as decoded from tasks""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct("id", F.from_json("payload", "k bigint")["k"].alias("k"))
    encoded = tasks(spark, sf_dir).select("id", F.to_json(payload).alias("encoded"))
    return encoded.withColumn("decoded", F.from_json("encoded", "id string, k bigint")["k"])


@query(f"{ordered._SETS} select queue, group_key, set_no, queue || '/' || group_key || '#' || set_no || ':' || count(*) || ':' || max(payload) as payload from closed group by 1, 2, 3", recursive=True)
def user_aggregated_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handlers.aggregate_sets(ordered._finished(spark, sf_dir), lambda queue, group, number, payloads: f"{queue}/{group}#{number}:{len(payloads)}:{max(payloads)}")


@query(
    """select d.spec, d.type, h.entry_id is not null as kept, h.entry_id from (select distinct 'every ' || (user_id % 50) as spec, event_type as type from events where event_id % 7 = 0) d
left join (select 'every ' || (user_id % 50) as spec, event_type as type, min(cast(event_id as varchar)) as entry_id from events where event_id % 5 = 0 group by 1, 2) h on h.spec = d.spec and h.type = d.type""",
    on_tasks=False,
)
def provider_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("every "), (F.col("user_id") % 50).cast("string")).alias("spec"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("entry_id"), "event_id")
    after = schedule.sync(rows.where("event_id % 5 = 0"), rows.where("event_id % 7 = 0"), ["spec", "type"])
    kept = ~F.col("entry_id").contains("-")  # a new entry's id is random
    return after.select("spec", "type", kept.alias("kept"), F.when(kept, F.col("entry_id")).alias("entry_id"))
