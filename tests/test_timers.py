"""Timers of streams across restarts, and sinks that send nothing twice."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from quaywise.streaming import timers

T0 = d.datetime(2026, 6, 1, 12)


@pytest.fixture(scope="module")
def timed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield timers.use_timers(spark)
    spark.conf.set(name, before)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def restarted(spark, folder, schema, form, name):
    """What the stream adds in one more run over its checkpoint."""
    out = form(spark.readStream.schema(schema).parquet(str(folder / "in")))
    found = []
    query = out.writeStream.foreachBatch(lambda b, i: found.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).queryName(name).start()
    query.awaitTermination()
    return sorted(found)


def test_alerts_fire_once_a_stage_and_day(timed, tmp_path):
    schema = "key string, due date, at timestamp"
    run = lambda: restarted(timed, tmp_path, schema, lambda s: timers.due_alerts(s, timers.FREE_TIME_STAGES), "due")
    add = lambda *rows: feed(timed, tmp_path, rows, schema)
    add(("a", d.date(2026, 6, 5), T0), ("b", d.date(2026, 6, 4), T0), ("c", d.date(2026, 6, 9), T0))
    assert run() == []
    add(("tick", None, T0 + d.timedelta(days=2)))  # 3 June: a and b are soon due
    assert run() == [("a", "soon", d.date(2026, 6, 5)), ("b", "soon", d.date(2026, 6, 4))]
    add(("a", d.date(2026, 6, 5), T0 + d.timedelta(days=2, hours=1)), ("b", d.date(2026, 6, 12), T0 + d.timedelta(days=2, hours=1)), ("tick", None, T0 + d.timedelta(days=2, hours=2)))
    assert run() == []  # a is told already, b has time again
    add(("c", None, T0 + d.timedelta(days=3)), ("tick", None, T0 + d.timedelta(days=5)))
    assert run() == [("a", "late", d.date(2026, 6, 5)), ("a", "today", d.date(2026, 6, 5))]
    add(("tick", None, T0 + d.timedelta(days=10)))
    assert run() == [("b", "soon", d.date(2026, 6, 12))]


def test_stalled_work_is_requeued_thrice_then_failed(timed, tmp_path):
    schema = "key string, ended boolean, at timestamp"
    run = lambda: restarted(timed, tmp_path, schema, timers.stalled_work, "stalled")
    add = lambda *rows: feed(timed, tmp_path, rows, schema)
    minute = lambda n: T0 + d.timedelta(minutes=n)
    add(("x", False, T0), ("y", False, T0))
    assert run() == []
    add(("y", True, minute(10)), ("tick", True, minute(31)))
    assert run() == [("x", "requeue", 1)]
    got = []
    for n in (62, 93, 124, 155):
        add(("tick", True, minute(n)))
        got += run()
    assert got == [("x", "requeue", 2), ("x", "requeue", 3), ("x", "error", 3)]


def test_an_outbox_takes_each_event_once(spark, tmp_path):
    root = f"file://{tmp_path}/outbox"
    write = timers.outbox(root, ["event_id", "receiver"])
    events = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "x"), (2, "a", "y")], "event_id int, receiver string, payload string")
    write(events, 0)
    write(events, 0)  # the batch is replayed
    write(events.filter("event_id = 2").unionByName(spark.createDataFrame([(3, "a", "z")], events.schema)), 1)
    write(events, 0)  # a stream begun anew
    got = sorted((r.event_id, r.receiver, r.batch) for r in spark.read.parquet(root).collect())
    assert got == [(1, "a", 0), (1, "b", 0), (2, "a", 0), (3, "a", 1)]


def test_digests_of_a_stream_are_claimed_once_a_day(spark, tmp_path):
    from quaywise.operators import workflow

    root = f"file://{tmp_path}/digests"
    write = timers.outbox(root, ["org_id", "day"])
    orgs = spark.createDataFrame([(1, "UTC"), (2, "America/New_York")], "org_id int, zone string")
    none = spark.createDataFrame([], "org_id int, day date")
    for i, hour in enumerate((7, 8, 11, 12)):
        due = workflow.digest_due(orgs, F.lit(d.datetime(2026, 6, 1, hour)).cast("timestamp"), none)
        write(due.select("org_id", "day"), i)
    assert sorted((r.org_id, r.day, r.batch) for r in spark.read.parquet(root).collect()) == [(1, d.date(2026, 6, 1), 0), (2, d.date(2026, 6, 1), 2)]
