import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideq.operators import admin, enqueue, grouping, lifecycle, running
from tideq.sources.tables import tasks


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


@pytest.fixture(params=[2_000_000, 7])
def slice_rows(request, monkeypatch):
    """The usual size of a slice, and one that cuts every key."""
    monkeypatch.setattr(running, "SLICE_ROWS", request.param)


def test_running_values_equal_one_window(spark, slice_rows):
    draw = random.Random(3)
    rows = [(draw.choice(["hot"] * 8 + ["a", None]), draw.choice([None, *range(12)]), i, draw.choice([None, 1, 2, 5])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    order = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("i", F.row_number().over(order).alias("n"), F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.max("v").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    got = running.numbered(df, ["k"], F.col("t"), ["t", "i"], "n")
    got = running.running_sum(got, ["k"], F.col("t"), ["t", "i"], F.col("v"), "s", inclusive=False)
    got = running.running_max(got, ["k"], F.col("t"), ["t", "i"], F.col("v"), "m").select("i", "n", "s", "m")
    assert sorted(got.collect()) == sorted(want.collect())


def lock_by_loop(requests, ends):
    """(accepted by tie) of requests (key, id, t, ttl, tie) and ends (key, id, t), one after the other."""
    until, owner, out = {}, {}, {}
    rows = [(t, 1, tie, k, i, ttl) for k, i, t, ttl, tie in requests] + [(t, 0, 0, k, i, None) for k, i, t in ends]
    for t, is_request, tie, k, i, ttl in sorted(rows, key=lambda r: r[:3]):
        free = t >= until.get(k, -1)
        if not is_request:
            if not free and owner[k] == i:
                until[k] = t
        else:
            out[tie] = free or ttl is None
            if free and ttl is not None:
                until[k], owner[k] = t + ttl, i
    return out


def test_archives_are_cut_alike_in_slices(spark, slice_rows):
    """The newest of each queue, those that have just come first, whatever the slices; nulls are oldest."""
    draw = random.Random(5)
    rows = [(draw.choice(["hot"] * 5 + ["a"]), i, draw.choice([None, *map(at, range(9))]), draw.choice(["archived", "archived", "retry"])) for i in range(90)]
    table = spark.createDataFrame(rows, "queue string, id long, enqueued_at timestamp_ntz, state string")
    age = lambda r: (r[2] is not None, r[2] or at(0), r[1])
    kept = lambda pick, first: {q: sorted((r for r in rows if r[0] == q and pick(r)), key=lambda r: (first(r), *age(r)), reverse=True)[:11] for q in ("hot", "a")}
    joined = admin.archive_all(table, ("retry",), kept=11).select("queue", "id", "moved", "state").collect()
    want = kept(lambda r: True, lambda r: r[3] == "retry")
    assert {(r.queue, r.id, r.moved, r.state) for r in joined} == {(q, r[1], int(r[3] == "retry"), "archived") for q, some in want.items() for r in some}
    trimmed = lifecycle.archive_trim(table, "2024-01-01 00:01:00", 11).select("queue", "id").collect()
    want = kept(lambda r: r[3] == "archived" and r[2] is not None, lambda r: 0)
    assert {(r.queue, r.id) for r in trimmed} == {(q, r[1]) for q, some in want.items() for r in some}


def test_locks_with_early_release_against_a_loop(spark, slice_rows):
    draw = random.Random(5)
    requests = [(draw.choice(["hot", "hot", "a", None]), f"i{draw.randrange(30)}", draw.randrange(400), draw.choice([None, 5, 40, 90]), n) for n in range(150)]
    ends = [(k, i, t + draw.choice([0, 3, 20])) for k, i, t, _, _ in requests[::2]]
    df = spark.createDataFrame([(k, i, at(t), ttl, n) for k, i, t, ttl, n in requests], "k string, id string, moment timestamp_ntz, ttl long, tie long")
    ended = spark.createDataFrame([(k, i, at(t)) for k, i, t in ends], "k string, id string, moment timestamp_ntz")
    got = enqueue.unique(df, ["k"], "moment", "ttl", "tie", ended).collect()
    assert {r.tie: r.accepted for r in got} == lock_by_loop(requests, ends)
    none = enqueue.unique(df, ["k"], "moment", "ttl", "tie").collect()
    assert {r.tie: r.accepted for r in none} == lock_by_loop(requests, [])


def test_ids_are_taken_in_order_of_time(spark):
    rows = [("q", "x", "k1", at(600), 10, 1), ("q", "x", "k2", at(300), 10, 2), (None, None, "k3", at(0), 10, 3)]
    requests = spark.createDataFrame(rows, "queue string, id string, k string, moment timestamp_ntz, ttl long, tie long")
    none = spark.createDataFrame([], "queue string, id string")
    assert {r.tie: r.status for r in enqueue.unique_status(requests, none, ["k"], "moment", "ttl", "tie").collect()} == {1: 0, 2: 1, 3: 1}


def test_admit_refuses_and_keeps_retention(spark, sf_dir):
    schema = "queue string, type string, id string, payload string, max_retries int, timeout long, deadline long, process_at timestamp_ntz, process_in int, group_key string, unique_for long, retain_for long, moment timestamp_ntz, tie long"
    rows = [
        ("q", "t", "1", "p", None, 0, 0, None, None, None, 60, 9, at(0), 1), ("q", "t", "2", "p", None, 0, 0, at(100), None, None, 60, None, at(10), 2), ("q", "t", "3", "p", None, 0, 0, at(100), None, None, 60, None, at(61), 3),
        ("q", "t", "4", "p", None, 0, 0, None, None, "g", 60, None, at(159), 4), ("q", " ", "5", "p", None, 0, 0, None, None, None, 60, None, at(500), 5), ("q", "t", "6", "p", None, 0, 0, None, None, None, 60, 10**10, at(500), 6),
        ("q", "t", "7", "p", None, 0, 0, None, None, "g", 60, None, at(165), 7),
    ]
    ends = spark.createDataFrame([("q", "t", "p", "3", at(164)), ("q", "t", "p", "1", at(163))], "queue string, type string, payload string, id string, moment timestamp_ntz")
    out = enqueue.admit(spark.createDataFrame(rows, schema), tasks(spark, sf_dir), "moment", "tie", ends).collect()
    got = {r.tie: (r.error, r.state, r.status, r.retention) for r in out}
    assert got == {
        1: (None, "pending", 1, 9), 2: (None, "scheduled", -1, 0), 3: (None, "scheduled", 1, 0), 4: (None, "aggregating", -1, 0),
        5: ("blank type", None, None, 0), 6: ("span too long", None, None, 10**10), 7: (None, "aggregating", 1, 0),
    }


def sets_by_loop(members, checks, size, delay, grace):
    """Sets of one queue's groups by going from check to check: id -> (set, place, reason, check)."""
    out = {}
    for group in {g for g, _, _ in members}:
        mine = sorted((t, i) for g, i, t in members if g == group)
        gone = number = 0
        for c in sorted(checks):
            seen = [m for m in mine if m[0] <= c][gone:]
            if not seen:
                continue
            reason = "size" if size and len(seen) >= size else "delay" if delay and seen[0][0] <= c - delay else "grace" if seen[-1][0] <= c - grace else None
            if reason:
                taken = seen[: size or None]
                number, gone = number + 1, gone + len(taken)
                out.update({(group, i): (number, n + 1, reason, at(c)) for n, (_, i) in enumerate(taken)})
    return out


@pytest.mark.parametrize(("size", "delay", "grace"), [(3, 60, 25), (0, 60, 25), (4, 0, 40), (1, 1, 0)])
def test_sets_at_checks_against_a_loop(spark, slice_rows, size, delay, grace):
    draw = random.Random(size)
    members = [(draw.choice("gggh"), f"m{i}", draw.randrange(500)) for i in range(90)]
    checks = draw.sample(range(620), 45)
    m = spark.createDataFrame([("q", g, i, at(t)) for g, i, t in members], "queue string, group_key string, id string, enqueued_at timestamp_ntz")
    c = spark.createDataFrame([("q", at(t)) for t in checks] + [("other", at(0))], "queue string, at timestamp_ntz")
    got = grouping.sets_at_checks(m, c, size, delay, grace).collect()
    assert {(r.group_key, r.id): (r.set_no, r.rn, r.reason, r.check_at) for r in got} == sets_by_loop(members, checks, size, delay, grace)
    assert all(r.deadline - r.check_at == timedelta(seconds=120) for r in got)
    assert grouping.sets_at_checks(m.limit(0), c, size, delay, grace).count() == 0


def test_sets_in_time_become_tasks_and_others_go_back(spark):
    rows = [("q", "g", str(i), at(i), n, rn, at(10), at(130), p, at(end)) for i, n, rn, p, end in ((1, 1, 2, "b", 129), (0, 1, 1, "a", 129), (2, 2, 1, "c", 130))]
    sets = spark.createDataFrame(rows, "queue string, group_key string, id string, enqueued_at timestamp_ntz, set_no long, rn int, check_at timestamp_ntz, deadline timestamp_ntz, payload string, finished_at timestamp_ntz")
    added, back = grouping.run_sets(sets, "finished_at")
    assert [(r.id, r.n, r.payload, r.state) for r in added.collect()] == [("q:g:1", 2, "a\nb", "pending")]
    assert [(r.id, r.reclaimed_at) for r in back.collect()] == [("2", at(130))]


def test_lock_lifecycle_with_equal_ties_against_its_sql(spark, sf_dir, tmp_path):
    """The tie repeats each 1,000,003 events; in copies of the table every tie is shared, some within a key and moment."""
    import duckdb

    from tideq.plans import ordered, registry

    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 700")
    copies = [events.withColumn("event_id", (F.col("event_id") + 1_000_003 * n).cast(events.schema["event_id"].dataType)) for n in (0, 1, 2)]
    copies[0].unionByName(copies[1]).unionByName(copies[2]).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = ordered.lock_lifecycle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(found.columns)} from ({registry.ORACLE_SQL['lock_lifecycle']})").fetchall()
    assert len(want) == 2100 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())
