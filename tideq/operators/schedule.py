"""Schedules: fixed intervals and cron lines as rows, and the difference of two sets of entries."""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.functions.scalar import every_seconds

# Names that stand for cron lines.
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
_MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13)))
_DAYS = dict(zip("sun mon tue wed thu fri sat".split(), range(7)))
_RANGES = ((0, 59, {}), (0, 23, {}), (1, 31, {}), (1, 12, _MONTHS), (0, 7, _DAYS))


def interval_ticks(entries: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row (entry_id, tick, task_id) for each multiple of the entry's ``seconds`` after the start, up to the end."""
    step = F.make_interval(secs=F.col("seconds"))
    first = start + step
    ticks = entries.where(F.col("seconds") >= 1).withColumn("tick", F.explode(F.when(first <= end, F.sequence(first, end, F.make_dt_interval(secs=F.col("seconds"))))))
    return ticks.withColumn("task_id", F.concat(F.col("entry_id").cast("string"), F.lit(":"), F.unix_seconds(F.col("tick").cast("timestamp")).cast("string")))


def due(entries: DataFrame, now: Column) -> DataFrame:
    """Entries whose next time has come, once each, with their next time counted from now: missed ticks aren't made up."""
    fired = entries.where(F.col("next_at") <= now)
    task_id = F.concat(F.col("entry_id").cast("string"), F.lit(":"), F.unix_seconds(F.col("next_at").cast("timestamp")).cast("string"))
    return fired.withColumn("task_id", task_id).withColumn("next_at", now + F.make_interval(secs=F.col("seconds")))


def _whole(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def _field(text: Column, low: int, high: int, names: dict[str, int]) -> Column:
    """The values of a cron field, sorted; null if it is malformed."""
    named = F.create_map(*(F.lit(x) for pair in (names or {"": -1}).items() for x in pair))
    number = lambda x: F.coalesce(F.element_at(named, x), _whole(x))

    def values(part: Column) -> Column:
        span, step = F.substring_index(part, "/", 1), F.when(part.contains("/"), F.regexp_replace(part, "^[^/]*/", ""))
        every = span.rlike(r"^([*?]|\?-\w+|\*-\w+)$")
        dash = span.contains("-")
        begin = F.when(every, F.lit(low)).otherwise(number(F.substring_index(span, "-", 1)))
        end = F.when(every, F.lit(high)).when(dash, number(F.regexp_replace(span, "^[^-]*-", ""))).when(step.isNotNull(), F.lit(high)).otherwise(begin)
        by = F.when(step.isNull(), F.lit(1)).otherwise(_whole(step))
        return F.when((begin >= low) & (begin <= end) & (end <= high) & (by >= 1), F.sequence(begin, end, by))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.lower(text), ",", -1), values))))


def parsed(entries: DataFrame) -> DataFrame:
    """``entries`` (spec) with zone, error, and what the cron line names: minutes, hours, days, months, weekdays and whether day or weekday is free.

    A line has five fields, or is a descriptor; a time zone may stand before it. The error of a wrong line is text, its other columns are null.
    """
    prefix = r"^(?:CRON_TZ|TZ)=(\S+)\s+"
    spec = F.trim(F.regexp_replace("spec", r"^\s+|\s+$", ""))
    line = F.regexp_replace(spec, prefix, "")
    known = F.create_map(*(F.lit(x) for pair in DESCRIPTORS.items() for x in pair))
    fields = F.split(F.coalesce(F.element_at(known, line), line), r"\s+", -1)
    zone = F.when(spec.rlike(prefix), F.regexp_extract(spec, prefix, 1)).otherwise("UTC")
    rows = entries.withColumns({"_fields": fields, "zone": zone})
    five = F.size("_fields") == 5
    names = ("minutes", "hours", "days", "months", "weekdays")
    rows = rows.withColumns({n: F.when(five, _field(F.get("_fields", F.lit(i)), *_RANGES[i])) for i, n in enumerate(names)})
    wrong = F.concat_ws(", ", *(F.when(F.col(n).isNull(), n) for n in names))
    error = (
        F.when(~five, F.concat(F.size("_fields").cast("string"), F.lit(" fields, not 5")))
        .when(wrong != "", F.concat(F.lit("malformed: "), wrong))
        .when(~F.expr(f"zone in ({', '.join(map(repr, sorted(available_timezones())))})"), F.concat(F.lit("unknown time zone "), F.col("zone")))
    )
    free = lambda i: F.get("_fields", F.lit(i)).rlike("^[*?]")
    rows = rows.withColumns({"error": error, "any_day": free(2), "any_weekday": free(4)})
    week = F.array_distinct(F.transform("weekdays", lambda d: d % 7))
    return rows.withColumn("weekdays", week).drop("_fields")


def _fits(day: Column) -> Column:
    """Whether a date is one that the line of the row names: day and weekday both count where one of them is free, else either."""
    by_day, by_week = F.array_contains("days", F.dayofmonth(day)), F.array_contains("weekdays", F.dayofweek(day) - 1)
    return F.array_contains("months", F.month(day)) & F.when(F.col("any_day") | F.col("any_weekday"), by_day & by_week).otherwise(by_day | by_week)


def _ticks(rows: DataFrame) -> DataFrame:
    """``rows`` (parsed, with day) with tick (UTC) for each hour and minute of the day, in the row's zone; local times that a change of the clocks leaves out have none."""
    each = rows.withColumn("_hour", F.explode("hours")).withColumn("_minute", F.explode("minutes"))
    local = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_hour"), F.col("_minute"))
    timed = each.withColumn("_local", local).withColumn("tick", F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("_local")))
    back = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("tick"))
    return timed.where(back == F.col("_local")).drop("_hour", "_minute", "_local")


def _local_date(moment: str, zone: Column) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, F.lit(moment).cast("timestamp_ntz")))


def cron_ticks(entries: DataFrame, start: str, end: str) -> DataFrame:
    """entry_id, spec, tick (UTC), error: each time after the start up to the end that the entry's cron line names; one row with the error of a wrong line.

    An entry meets the days of the span that its line names, these its hours and minutes: calendar rows come from the fields, no line is run minute by minute.
    Where clocks are set back, the first of two equal local times counts.
    """
    lines = parsed(entries.select("entry_id", "spec"))
    fine = lines.where("error is null")
    days = F.filter(F.sequence(_local_date(start, F.col("zone")), _local_date(end, F.col("zone"))), _fits)
    ticks = _ticks(fine.withColumn("day", F.explode(days)))
    within = (F.col("tick") > F.lit(start).cast("timestamp_ntz")) & (F.col("tick") <= F.lit(end).cast("timestamp_ntz"))
    wrong = lines.where("error is not null").select("entry_id", "spec", F.lit(None).cast("timestamp_ntz").alias("tick"), "error")
    return ticks.where(within).select("entry_id", "spec", "tick", "error").unionByName(wrong)


def cron_next(entries: DataFrame, now: str, years: int = 41) -> DataFrame:
    """entry_id, spec, next_at (UTC): the first time after ``now`` that each entry's line names; null if none comes within ``years``, or the line is wrong.

    A date and weekday that both must fit come again within 40 years, also across a century without a leap day.
    Each row goes on from month to month, day to day and hour to hour until it has its time: days are run through only in months that the line names,
    hours only on days that it names, and nothing behind the time found.
    """
    lines = parsed(entries.select("entry_id", "spec"))
    after, none = F.lit(now).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    today = _local_date(now, F.col("zone"))
    last = F.add_months(today, 12 * years)

    def first(items: Column, of: Callable[[Column], Column]) -> Column:
        """What ``of`` gives for the first item for which it isn't null; later ones are not looked at."""
        return F.aggregate(items, none, lambda found, x: F.when(found.isNotNull(), found).otherwise(of(x)))

    def in_hour(day: Column, hour: Column) -> Column:
        def tick(minute: Column) -> Column:
            local = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)
            utc = F.convert_timezone(F.col("zone"), F.lit("UTC"), local)
            return F.when((utc > after) & (F.convert_timezone(F.lit("UTC"), F.col("zone"), utc) == local), utc)

        return first(F.col("minutes"), tick)

    def in_month(month: Column) -> Column:
        days = F.filter(F.sequence(F.greatest(month, today), F.least(F.last_day(month), last)), _fits)
        return F.when(F.array_contains("months", F.month(month)), first(days, lambda day: first(F.col("hours"), lambda hour: in_hour(day, hour))))

    months = F.sequence(F.trunc(today, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return lines.select("entry_id", "spec", F.when(F.col("error").isNull(), first(months, in_month)).alias("next_at"))


def periodic_key(spec: Column, kind: Column, payload: Column, options: Column) -> Column:
    """What makes two periodic entries the same; headers don't count, nor does the order of options."""
    return F.struct(spec.alias("spec"), kind.alias("type"), payload.alias("payload"), F.array_sort(options).alias("options"))


def periodic_diff(desired: DataFrame, registered: DataFrame, key: list[str]) -> DataFrame:
    """The keys of either side with change: added, stale or unchanged."""
    both = desired.select(*key, F.lit(1).alias("d"), F.lit(0).alias("r")).unionByName(registered.select(*key, F.lit(0).alias("d"), F.lit(1).alias("r")))
    side = both.groupBy(*key).agg(F.max("d").alias("d"), F.max("r").alias("r"))
    return side.select(*key, F.when(F.col("r") == 0, "added").when(F.col("d") == 0, "stale").otherwise("unchanged").alias("change"))


def every_entries(entries: DataFrame) -> DataFrame:
    """The entries whose ``spec`` is an ``@every`` line, with seconds: rows for ``interval_ticks`` and ``due``."""
    return entries.withColumn("seconds", every_seconds(F.col("spec"))).where("seconds is not null")


def register(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` with those of ``new``, which take the place of entries of the same entry_id; one without an id gets a random one."""
    named = new.withColumn("entry_id", F.coalesce("entry_id", F.uuid()))
    return unregister(entries, named).unionByName(named)


def unregister(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("entry_id").distinct(), "entry_id", "left_anti")


def sync(entries: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """``entries`` (entry_id and the key) after a provider's ``desired`` configurations: stale ones go, unchanged ones keep their id, added ones get a random one.

    Configurations of equal keys count once, as do entries: the smallest id stays.
    """
    held = entries.groupBy(*key).agg(F.min("entry_id").alias("entry_id"))
    return desired.select(*key).distinct().join(held, key, "left").withColumn("entry_id", F.coalesce("entry_id", F.uuid()))
