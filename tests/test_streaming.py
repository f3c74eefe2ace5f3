from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideq.operators import enqueue, timers
from tideq.sources.tables import NOW, read, tasks
from tideq.streaming import processors, runs


def run(query_df, name, tmp_path, mode="append"):
    query = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return query_df.sparkSession.table(name)


def as_stream(spark, df, path, files=3):
    df.repartition(1).write.option("maxRecordsPerFile", max(1, df.count() // files)).parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run_in_batches(spark, batches, schema, make, tmp_path):
    """Rows that ``make``'s stream gives when the batches come one after the other, and the state rows it holds after each."""
    source, held = tmp_path / "source", []
    source.mkdir()
    stream = make(spark.readStream.schema(schema).parquet(str(source)))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"batch{n}"))
        for i, part in enumerate(sorted((tmp_path / f"batch{n}").glob("part-*.parquet"))):
            part.rename(source / f"{n}-{i}.parquet")
        query = runs.start(stream, str(tmp_path / "out"))  # a new run each time: state and progress are read back
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out" / "rows")).collect(), held


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_due_stream_equals_batch(spark, sf_dir, tmp_path):
    known = tasks(spark, sf_dir)
    stream = as_stream(spark, known, tmp_path / "in")
    got = run(processors.due_stream(stream, NOW).select("id", "new_state"), "due", tmp_path)
    assert sorted(got.collect()) == sorted(timers.forward(known, NOW).select("id", "new_state").collect())


def test_quiet_groups_close_once(spark, tmp_path):
    rows = spark.sql("select 'q' queue, 'g' group_key, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) at from values (0), (1), (10), (11), (60) t(m)")
    got = run(processors.quiet_groups(as_stream(spark, rows.orderBy("at"), tmp_path / "in", files=5), "5 minutes", "0 minutes"), "quiet", tmp_path)
    assert sorted(r.n for r in got.collect()) == [2, 2]


MEMBERS = [("q", "g", str(i), at(m)) for i, m in enumerate((0, 1, 2, 3, 30, 41, 52, 63, 75, 200, 201, 201))] + [("q", None, "x", at(5)), ("q", "h", "y", at(100))]
CLOCK = [("q", "z", "end", at(10_000)), ("q", "z", "end2", at(20_000))]
#: max_size 3, max_delay 40 minutes, grace 12 minutes.
SETS = {
    "0": (1, "size"), "1": (1, "size"), "2": (1, "size"), "3": (2, "grace"), "4": (3, "size"), "5": (3, "size"), "6": (3, "size"), "7": (4, "grace"), "8": (5, "grace"),
    "9": (6, "size"), "10": (6, "size"), "11": (6, "size"), "x": (1, "grace"), "y": (1, "grace"),
}


@pytest.mark.parametrize("cuts", [(), (1, 3, 6, 9)])
def test_sets_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = sorted(MEMBERS, key=lambda r: r[3])
    batches = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))] + [CLOCK[:1], CLOCK[1:]]
    make = lambda s: processors.flush_stream(s, "1 minute", 3, 40 * 60, 12 * 60)
    got, held = run_in_batches(spark, batches, "queue string, group_key string, id string, at timestamp", make, tmp_path)
    assert {r.id: (r.set_no, r.reason) for r in got if r.group_key != "z"} == SETS
    assert max(held[:-2]) > 0 and held[-1] < 10


def test_rules_without_bounds_and_delay(spark, tmp_path):
    rows = [("q", "g", str(m), at(m)) for m in range(0, 100, 10)]
    make = lambda s: processors.flush_stream(s, "1 minute", 0, 35 * 60, 60 * 60)
    got, _ = run_in_batches(spark, [rows, CLOCK[:1]], "queue string, group_key string, id string, at timestamp", make, tmp_path)
    assert {int(r.id): (r.set_no, r.reason) for r in got} == {m: (1 + m // 40, "delay") for m in range(0, 100, 10)}


@pytest.mark.parametrize("cuts", [(), (1, 3, 5)])
def test_lock_equals_batch_and_is_forgotten(spark, tmp_path, cuts):
    rows = [("k", i, at(m)) for i, m in enumerate((0, 40, 59, 60, 110, 119, 120))] + [(f"k{i}", 100 + i, at(120)) for i in range(20)]
    clock = [("end", 1000, at(10_000))]
    batches = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))] + [clock]
    got, held = run_in_batches(spark, batches, "key string, id long, at timestamp", lambda s: processors.unique_stream(s, 3600, "1 minute"), tmp_path)
    want = enqueue.unique(spark.createDataFrame(rows, "key string, id long, at timestamp"), ["key"], "at", 3600, "id").collect()
    assert {r.id: r.accepted for r in got if r.key != "end"} == {str(r.id): r.accepted for r in want}
    assert held[-1] <= 3 < max(held)  # only the clock's own row is left: what has run out isn't state any more


def test_release_when_due_and_leaves_the_state(spark, tmp_path):
    schema = "queue string, id string, state string, group_key string, at timestamp, process_at timestamp"
    rows = [("q", "a", "scheduled", "", at(0), at(50)), ("q", "b", "retry", "g", at(1), at(2)), ("q", "c", "pending", "", at(1), at(2)), ("q", "d", "retry", "", at(1), None)]
    later = [("q", "a", "retry", "", at(3), at(90)), ("q", "e", "scheduled", "", at(60), at(1))]
    make = lambda s: processors.forward_stream(s, "1 minute")
    got, held = run_in_batches(spark, [rows, later, [("q", "end", "retry", "", at(200), at(999))]], schema, make, tmp_path)
    assert sorted((r.id, r.outcome, r.due) for r in got) == [("a", "pending", at(90)), ("b", "aggregating", at(2)), ("e", "pending", at(1))]
    assert held[-1] <= 2


def test_cancellations_within_their_interval(spark, tmp_path):
    schema = "id string, at timestamp, kind string"
    rows = [("a", at(0), "start"), ("b", at(0), "start"), ("c", at(10), "start"), ("d", at(0), "start")]
    asked = [("a", at(20), "cancel"), ("a", at(21), "cancel"), ("b", at(31), "cancel"), ("c", at(9), "cancel"), ("d", at(0), "cancel"), ("none", at(5), "cancel")]

    def make(s):
        started = s.where("kind = 'start'").select("id", F.col("at").alias("started_at"))
        return processors.cancelled_stream(started, s.where("kind = 'cancel'").select("id", "at"), "1 hour", "30 minutes")

    got, held = run_in_batches(spark, [asked[:1], rows, asked[1:], [("end", at(999), "start"), ("end2", at(999), "cancel")]], schema, make, tmp_path)
    assert sorted(r.id for r in got) == ["a", "d"]
    assert held[-1] < max(held)


def test_a_registered_stream_reads_the_whole_table(spark, sf_dir):
    from tideq.plans import streams

    accepted = streams.stream_lock(spark, sf_dir)
    events = read(spark, sf_dir, "events")
    assert accepted.count() == events.where(F.col("ts") <= F.lit(events.agg(F.max("ts")).first()[0] - timedelta(hours=1))).count()


@pytest.mark.parametrize("kind", ["lock", "release"])
def test_state_is_kept_by_bucket_not_by_key(spark, tmp_path, kind):
    """4,000 keys: a state of each key by itself is some calls into Python for each, which grew to an hour at 6 GB."""
    if kind == "lock":
        rows, schema = [(f"k{i}", i, at(i % 50)) for i in range(4_000)], "key string, id long, at timestamp"
        end, make = ("end", -1, at(10_000)), lambda s: processors.unique_stream(s, 3600, "1 minute")
    else:
        rows, schema = [("q", f"k{i}", "retry", "", at(i % 50), at(60 + i % 7)) for i in range(4_000)], "queue string, id string, state string, group_key string, at timestamp, process_at timestamp"
        end, make = ("q", "end", "retry", "", at(10_000), at(99_999)), lambda s: processors.forward_stream(s, "1 minute")
    got, held = run_in_batches(spark, [rows, [end]], schema, make, tmp_path)
    assert len({r.id for r in got}) == len(got) == 4_000
    assert max(held) <= 2_000 and held[-1] <= 8, held
