"""Streaming twins of the timers, the group flush, the uniqueness lock and cancellations.

Rows of a key wait in its state until the watermark has passed them, and are then
taken in order of time and id, so that the result doesn't depend on the batches
in which they came. What a timer has closed leaves the state. Clocks are the
watermark, never the machine's time: a row or a deadline, in milliseconds rounded up, counts once the
watermark has reached it. The watermark follows the rows that an operator takes. Rows that come behind the watermark are dropped by the engine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets to which the keys of locks and releases are dealt; no result depends on it.
BUCKETS = 512
#: Rows of a pack of state, at most.
PACK = 10_000


def due_stream(tasks: DataFrame, clock: str) -> DataFrame:
    """A stream of tasks (state, process_at, group_key) with new_state for each that is due by ``clock``."""
    from tideq.operators.timers import forward

    return forward(tasks, clock)


def quiet_groups(events: DataFrame, grace: str, late: str) -> DataFrame:
    """Sessions of each group, closed when nothing has come for ``grace``: queue, group_key, start, end, n."""
    session = F.session_window("at", grace)
    return (
        events.withWatermark("at", late).groupBy(session.alias("s"), "queue", "group_key").agg(F.count("*").alias("n"))
        .select("queue", "group_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def _millis(micros: int) -> int:
    """Micros as milliseconds, rounded up."""
    return -(-micros // 1000)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _bucket(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).alias("_bucket")


class InOrder(StatefulProcessor):
    """Rows (id, at) of a key, handed to ``fold`` in order once the watermark has passed them."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for batch in rows:
            at = _micros(batch["at"])
            self.waiting.appendList(list(zip(at, batch["id"].tolist())))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(_millis(first))
        yield self.frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get())
        ready = sorted((r for r in every if _millis(r[0]) <= clock), key=lambda r: (r[0], r[1].encode()))
        rest = [r for r in every if _millis(r[0]) > clock]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        out, deadline = self.fold(ready, clock)
        if rest:
            self.handle.registerTimer(_millis(min(r[0] for r in rest)))
        if deadline is not None:
            self.handle.registerTimer(_millis(deadline))
        yield self.frame([(*key, *row) for row in out])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.columns))
        for name in ("at", "closed_at"):
            if name in self.columns:
                out[name] = pd.to_datetime(out[name].astype("int64"), unit="us")
        return out

    def fold(self, rows: list[tuple[int, str]], clock: int) -> tuple[list[tuple], int | None]:
        """What ``rows`` give, without the key, and when the key wants to be looked at again (micros)."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class FlushRules(InOrder):
    """Sets of a group's members: closed by size at once, or when the oldest is ``max_delay`` or the newest ``grace`` seconds old."""

    columns = ("queue", "group_key", "id", "at", "set_no", "reason", "closed_at")

    def __init__(self, max_size: int, max_delay: int, grace: int):
        self.max_size, self.max_delay, self.grace = max_size, max_delay * 1_000_000, grace * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.members = handle.getListState("members", "at long, id string")
        self.number = handle.getValueState("number", "n long")

    def fold(self, rows: list[tuple[int, str]], clock: int) -> tuple[list[tuple], int | None]:
        held = list(self.members.get())
        number = self.number.get()[0] if self.number.exists() else 1
        before, out = len(held), []

        def deadline() -> tuple[int, str]:
            by_grace = held[-1][0] + self.grace, "grace"
            return min((held[0][0] + self.max_delay, "delay"), by_grace) if self.max_delay else by_grace

        def close(at: int, reason: str) -> None:
            nonlocal number
            out.extend((id_, moment, number, reason, at) for moment, id_ in held)
            held.clear()
            number += 1

        for row in rows:
            if held and deadline()[0] <= row[0]:
                close(*deadline())
            held.append(tuple(row))
            if len(held) == self.max_size:
                close(row[0], "size")
        if held and _millis(deadline()[0]) <= clock:
            close(*deadline())
        if out:
            self.number.update((number,))
            before = 0
            self.members.clear()
        if held[before:]:
            self.members.appendList([tuple(r) for r in held[before:]])
        return out, deadline()[0] if held else None


def flush_stream(members: DataFrame, late: str, max_size: int, max_delay: int, grace: int) -> DataFrame:
    """Closed sets of a stream of members (queue, group_key, id, at), a row a member: set_no counts a group's sets from 1.

    A bound of 0 sets none. A deadline that falls on a member's time closes the set before it.
    """
    rows = members.withWatermark("at", late).select("queue", "group_key", F.col("id").cast("string").alias("id"), "at")
    schema = "queue string, group_key string, id string, at timestamp, set_no long, reason string, closed_at timestamp"
    return rows.groupBy("queue", "group_key").transformWithStateInPandas(FlushRules(max_size, max_delay, grace), schema, "append", "EventTime")


class Packed(StatefulProcessor):
    """Rows of all keys of a bucket, in packs of state, read when the watermark has passed the first that is due.

    Each access to the state is a message to the engine, so that a key of few rows is dear by itself. Here a batch of a
    bucket is one pack, whatever its keys. A bucket is read and written as a whole: there should be so many that one fits a worker's memory.
    """

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pack string")
        self.seen: dict[tuple, int] = {}  # the clock at which a bucket was last read in this batch

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.appendValue((json.dumps(rows),))

    def packs(self) -> Iterator[list]:
        for (pack,) in self.waiting.get():
            yield json.loads(pack)

    def keep(self, rows: list) -> None:
        """Only these rows are waiting."""
        self.waiting.clear()
        for i in range(0, len(rows), PACK):
            self.add(rows[i : i + PACK])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        # several timers of a bucket may have passed: the first looks after them all
        if self.seen.get(key) != clock:
            self.seen[key] = clock
            yield self.frame(self.expire(clock))
        else:
            yield self.frame([])

    def expire(self, clock: int) -> list[tuple]:
        raise NotImplementedError

    def frame(self, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.columns))
        for name in ("at", "due"):
            if name in self.columns:
                out[name] = pd.to_datetime(out[name].astype("int64"), unit="us")
        return out

    def close(self) -> None:
        pass


class Locks(Packed):
    """The locks of a bucket's keys: each taken by a row when no earlier one holds it, and forgotten by a timer when it ends."""

    columns = ("key", "id", "at", "accepted")

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "pack string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.seen.pop(key, None)
        first = None
        for batch in rows:
            at = _micros(batch["at"])
            self.add(list(zip(batch["key"].tolist(), at, batch["id"].tolist())))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(_millis(first))
        yield self.frame([])

    def expire(self, clock: int) -> list[tuple]:
        every = [row for pack in self.packs() for row in pack]
        ready = sorted((r for r in every if _millis(r[1]) <= clock), key=lambda r: (r[1], r[2].encode()))
        rest = [r for r in every if _millis(r[1]) > clock]
        before = [pair for (pack,) in self.held.get() for pair in json.loads(pack)]
        until, out = dict(map(tuple, before)), []
        for name, at, id_ in ready:
            end = until.get(name)
            free = end is None or at >= end
            if free:
                until[name] = at + self.ttl
            out.append((name, id_, at, free))
        left = [(name, end) for name, end in until.items() if _millis(end) > clock]
        if ready:
            self.keep(rest)
        if ready or len(left) < len(before):
            self.held.clear()
            for i in range(0, len(left), PACK):
                self.held.appendValue((json.dumps(left[i : i + PACK]),))
        for next_ in ([r[1] for r in rest], [end for _, end in left]):
            if next_:
                self.handle.registerTimer(_millis(min(next_)))
        return out


def unique_stream(events: DataFrame, ttl: int, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """key, id, at, accepted of the events (key, id, at): accepted if no accepted one of the key preceded by less than ``ttl`` seconds."""
    rows = events.withWatermark("at", late).select(_bucket(buckets, "key"), "key", F.col("id").cast("string").alias("id"), "at")
    return rows.groupBy("_bucket").transformWithStateInPandas(Locks(ttl), "key string, id string, at timestamp, accepted boolean", "append", "EventTime")


class Release(Packed):
    """One row of each key of a bucket, kept until the watermark has passed its ``due``; a later row of the key takes its place."""

    columns = ("queue", "id", "outcome", "due")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.seen.pop(key, None)
        last: dict[tuple, tuple] = {}
        for batch in rows:
            for queue, id_, *newest in zip(batch["queue"].tolist(), batch["id"].tolist(), _micros(batch["at"]), _micros(batch["due"]), batch["outcome"].tolist()):
                last[queue, id_] = max(last.get((queue, id_), newest), newest)
        clock = timerValues.getCurrentWatermarkInMs()
        out, kept = [], []
        for (queue, id_), (_, due, outcome) in last.items():
            if _millis(due) <= clock:
                out.append((queue, id_, outcome, due))
            kept.append((queue, id_, outcome, None if _millis(due) <= clock else due))  # None: what was kept of the key is no more
        for i in range(0, len(kept), PACK):
            self.add(kept[i : i + PACK])
        if kept:
            self.handle.registerTimer(min(clock + 1 if due is None else _millis(due) for *_, due in kept))
        yield self.frame(out)

    def expire(self, clock: int) -> list[tuple]:
        kept = {(queue, id_): (outcome, due) for pack in self.packs() for queue, id_, outcome, due in pack}
        rows = [(*name, *row) for name, row in kept.items() if row[1] is not None]
        rest = [r for r in rows if _millis(r[3]) > clock]
        self.keep(rest)
        if rest:
            self.handle.registerTimer(_millis(min(r[3] for r in rest)))
        return [r for r in rows if _millis(r[3]) <= clock]


def release_stream(rows: DataFrame, late: str, due: Column, outcome: Column, buckets: int = BUCKETS) -> DataFrame:
    """queue, id, outcome, due of each row (queue, id, at) of the stream once the watermark has passed ``due``; only then it leaves the state."""
    timed = rows.withWatermark("at", late).select(_bucket(buckets, "queue", "id"), "queue", F.col("id").cast("string").alias("id"), "at", due.cast("timestamp").alias("due"), outcome.alias("outcome")).where("due is not null")
    return timed.groupBy("_bucket").transformWithStateInPandas(Release(), "queue string, id string, outcome string, due timestamp", "append", "EventTime")


def forward_stream(tasks: DataFrame, late: str) -> DataFrame:
    """Scheduled and retried tasks of a stream (with at), released at their process_at: into their group if they have one, else pending."""
    waiting = tasks.where(F.col("state").isin("scheduled", "retry"))
    return release_stream(waiting, late, F.col("process_at"), F.when(F.col("group_key") != "", "aggregating").otherwise("pending"))


def expire_stream(tasks: DataFrame, late: str) -> DataFrame:
    """Completed tasks of a stream (with at), expired when their retention is over."""
    until = F.col("enqueued_at") + F.make_interval(secs=F.col("retention"))
    return release_stream(tasks.where("state = 'completed'"), late, until, F.lit("expired"))


def cancelled_stream(active: DataFrame, cancellations: DataFrame, late: str, within: str) -> DataFrame:
    """Tasks (id, started_at) of a stream for which a cancellation (id, at) came from their start to ``within`` after it, once each.

    Either side may come first; the join keeps no row longer than the interval
    and the lateness ask. A cancellation before the start, later than the interval or behind
    the watermark cancels nothing.
    """
    left = active.withWatermark("started_at", late).select("id", "started_at")
    right = cancellations.withWatermark("at", late).select(F.col("id").alias("cancelled_id"), F.col("at").alias("cancelled_at"))
    meets = F.expr(f"id = cancelled_id and cancelled_at >= started_at and cancelled_at <= started_at + interval {within}")
    return left.join(right, meets, "inner").select("id", "started_at").dropDuplicatesWithinWatermark(["id"])
