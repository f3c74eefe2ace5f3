import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideq.functions import scalar
from tideq.operators import counters, handlers, leases, lifecycle, timers
from tideq.sources import snapshots
from tideq.sources.tables import NOW, tasks


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_write_back_rewrites_touched_folders_only(spark, sf_dir, tmp_path):
    known = tasks(spark, sf_dir).select("queue", "id", "state", "payload")
    path = str(tmp_path / "tasks")
    snapshots.create(known, path, 8)
    before = files(path)
    one = known.where("id = '100'").withColumn("payload", F.lit("changed"))
    snapshots.upsert(spark, path, one, 8, str(tmp_path / "staged"))
    after = files(path)
    folder = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(folder) == 1 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in folder)
    want = {(r.queue, r.id, r.state, "changed" if r.id == "100" else r.payload) for r in known.collect()}
    assert {tuple(r) for r in snapshots.load(spark, path).select("queue", "id", "state", "payload").collect()} == want


def test_deleted_tasks_are_passed_over_and_may_come_back(spark, tmp_path):
    path = str(tmp_path / "tasks")
    rows = spark.createDataFrame([("q", "1", "a"), ("q", "2", "b")], "queue string, id string, payload string")
    snapshots.create(rows, path, 1)
    snapshots.upsert(spark, path, rows.withColumn("deleted", F.lit(True)), 1, str(tmp_path / "s1"))
    assert snapshots.load(spark, path).count() == 0
    snapshots.upsert(spark, path, rows.limit(1).withColumn("payload", F.lit("again")), 1, str(tmp_path / "s2"))
    snapshots.upsert(spark, path, rows.where("id = '2'").limit(0), 1, str(tmp_path / "s3"))
    assert [tuple(r) for r in snapshots.load(spark, path).select("id", "payload").collect()] == [("1", "again")]


def test_counters_merge_in_any_grouping_and_expire(spark):
    rows = [("q", "completed", datetime(2024, 1, d)) for d in (1, 1, 2)] + [("q", "retry", datetime(2024, 1, 1)), ("q", "pending", datetime(2024, 1, 9)), (None, "archived", datetime(2024, 1, 3))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "queue string, state string, enqueued_at timestamp_ntz, i int")
    parts = [counters.counted(df.where(F.col("i") % 3 == k)) for k in range(3)]
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    whole = key(counters.counted(df))
    assert whole == key(counters.merged(*parts)) == key(counters.merged(parts[2], counters.merged(parts[1], parts[0])))
    assert whole == sorted([("q", date(2024, 1, 1), 3, 1), ("q", date(2024, 1, 2), 1, 0), (None, date(2024, 1, 3), 1, 1)], key=str)
    assert key(counters.totals(counters.merged(*parts))) == sorted([("q", 4, 1), (None, 1, 1)], key=str)
    kept = counters.unexpired(counters.merged(*parts), "2024-01-04 10:00:00", 3)
    assert sorted(r.day.day for r in kept.collect()) == [2, 3]


def test_typed_payloads_and_context(spark):
    mux = handlers.TypedMux()
    none = F.lit(None).cast("string")
    mux.handle("t", "n int, s struct<x: string>", lambda p, c: (F.concat_ws("|", p["n"].cast("string"), p["s"]["x"], c["id"], c["retried"].cast("string")), F.when(p["n"] < 0, "revoke")))
    with pytest.raises(ValueError):
        mux.handle("t", "n int", lambda p, c: (none, none))
    rows = [("1", "t", '{"n": 1, "s": {"x": "y"}, "more": [1]}'), ("2", "t", "{"), ("3", "t", '{"n": "word"}'), ("4", "t", None), ("5", "t", '{"n": -1}'), ("6", "u", "{}"), ("7", None, "{}"), ("8", "t", "")]
    tasks_ = spark.createDataFrame([(*r, 2) for r in rows], "id string, type string, payload string, retried int")
    out = {r.id: (r.ok, r.error, r.result) for r in mux.run(tasks_).collect()}
    assert out["1"] == (True, None, "1|y|1|2") and out["4"] == (True, None, "4|2") and out["5"] == (False, "revoke", None)
    assert all(out[i][:2] == (False, "failed") for i in "23678")
    assert {r.id for r in handlers.failures(mux.run(tasks_)).collect()} == set("235678")


def test_queue_names_and_the_default_queue(spark):
    names = spark.createDataFrame([(" ", 5), (" ", 2), ("a", 0), ("b", -1)], "queue string, priority int")
    assert [tuple(r) for r in lifecycle.strict_order(names).collect()] == [("default", 1)]
    assert [r.queue for r in lifecycle.weighted_order(names).collect()] == ["default"]
    more = names.unionByName(spark.createDataFrame([("c", 1), ("d", 2)], "queue string, priority int"))
    assert [r.queue for r in lifecycle.strict_order(more).orderBy("rank").collect()] == ["d", "c"]


def test_retry_after_a_delay_of_its_own_and_kept_failure_times(spark, sf_dir):
    known = tasks(spark, sf_dir)
    now = int(datetime.fromisoformat(NOW + "+00:00").timestamp())
    assert {r.retry_at for r in lifecycle.retry(known, NOW, F.lit(True), F.lit(0), F.lit(7)).collect()} == {now + 7}
    failed = timers.recover_fully(known.withColumn("last_failed_at", F.lit(5)), NOW, F.lit(0), is_failure=F.lit(False))
    assert {(r.new_state, r.last_failed_at) for r in failed.collect()} == {("retry", 5), ("archived", now)}


def test_instants_before_1970_and_spans(spark):
    df = spark.sql("select timestamp_ntz '1969-12-31 23:59:59.25' t, timestamp_ntz '0001-01-01 00:00:00' zero, timestamp_ntz '9999-12-31 00:00:00' far")
    at = scalar.instant_of(F.col("t"))
    row = df.select(at.alias("at"), scalar.time_of(at).alias("back"), scalar.time_of(scalar.instant_of(F.col("zero"))).alias("never"), scalar.nanos_between(F.col("far"), F.col("zero")).alias("wide"), scalar.time_of(F.lit(None).cast("struct<seconds: bigint, nanos: int>")).alias("none")).first()
    assert tuple(row["at"]) == (-1, 250_000_000) and row["back"] == datetime(1969, 12, 31, 23, 59, 59, 250_000) and row["never"] is None
    assert int(row["wide"]) == (datetime(9999, 12, 31) - datetime(1, 1, 1)) // timedelta(microseconds=1) * 1000 and row["none"] == datetime(1970, 1, 1)


def test_lease_policies_and_lost_tasks(spark):
    start = datetime(2024, 1, 1)
    after = lambda s: start + timedelta(seconds=s)
    runs = spark.createDataFrame([("a", after(0), after(100)), ("b", after(0), after(30)), ("c", after(0), None)], "task_id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    count = lambda *policy: sorted((r.task_id, r.kind) for r in leases.extensions(runs, *policy).collect())
    assert count("none") == [(t, "start") for t in "abc"]
    assert count("before") == sorted((t, k) for t in "abc" for k in ("start", "beat"))
    assert count("every", 30) == sorted([(t, "start") for t in "abc"] + [("a", "beat")] * 3)
    with pytest.raises(ValueError):
        leases.extensions(runs, "every")
    beats = [("t", -5, "beat", 10), ("t", 0, "start", 30), ("t", 20, "beat", 30), ("t", 60, "beat", 30), ("t", 120, "beat", 30), ("t", 125, "beat", 30), ("t", 200, "start", 1000), ("t", 210, "beat", 10)]
    df = spark.createDataFrame([(t, after(s), n, k, lease) for n, (t, s, k, lease) in enumerate(beats)], "task_id string, at timestamp_ntz, tie int, kind string, lease int")
    spans, gaps = leases.lease_spans(df, grace=30)
    assert sorted(tuple(r)[1:] for r in spans.collect()) == [(1, after(0), after(90), 2, 2), (2, after(200), after(1200), 1, 0)]
    assert sorted(tuple(r)[1:] for r in gaps.collect()) == [(1, after(50), after(60), False), (1, after(90), after(200), True), (2, after(1200), None, True)]
