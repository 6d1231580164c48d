"""Streams settle to the batch result, also over several micro-batches."""

import datetime as dt
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.sources import market
from tidemark.sources.files import scratch
from tidemark.streaming import live


def batch_events(spark, sf_dir):
    return market.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def parts(spark, sf_dir):
    """The same events as several files in time order, read one file per micro-batch."""
    path = scratch(spark, "events")
    e = batch_events(spark, sf_dir)
    for lo, hi in ((1, 8), (9, 16), (17, 24), (25, 31)):
        e.where(F.dayofmonth("ts").between(lo, hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_bars_over_micro_batches(spark, sf_dir):
    want = live.tumbling_bars(batch_events(spark, sf_dir)).drop("mean")
    got = live.settle(live.tumbling_bars(parts(spark, sf_dir)), ["event_type", "start"]).drop("mean")
    assert rows(got.select(want.columns)) == rows(want)


def shuffled_parts(spark, sf_dir):
    """Files whose events overlap in time, so most micro-batches bring late rows."""
    path = scratch(spark, "events")
    e = batch_events(spark, sf_dir)
    for k in range(4):
        e.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def switches(windows, events):
    return rows(live.latch_switches(windows, live.crossings(events, 100.0, 20.0)))


def test_latch_state_survives_micro_batches(spark, sf_dir):
    keys = ["event_type", "start"]
    e = batch_events(spark, sf_dir)
    want = switches(live.latch_windows(e, 100.0, 20.0), e)
    assert switches(live.settle(live.latch_windows(parts(spark, sf_dir), 100.0, 20.0), keys), e) == want and want


def test_late_rows_revise_the_latch(spark, sf_dir):
    keys = ["event_type", "start"]
    e = batch_events(spark, sf_dir)
    late = live.settle(live.latch_windows(shuffled_parts(spark, sf_dir), 100.0, 20.0, late="60 days"), keys)
    assert switches(late, e) == switches(live.latch_windows(e, 100.0, 20.0), e)


def test_latch_summaries_merge_and_stay_small(spark, sf_dir):
    """Hours merged to days equal days; a summary has the same three fields however many rows it stands for."""
    e = batch_events(spark, sf_dir)
    hours, days = live.latch_windows(e, 100.0, 20.0), live.latch_windows(e, 100.0, 20.0, "1 day")
    assert rows(live.merge_windows(hours, "1 day")) == rows(days)
    many = e.unionByName(e.withColumn("event_id", F.col("event_id") + 10_000_000).withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond")))
    assert live.latch_windows(many, 100.0, 20.0).count() == hours.count()
    assert live.latch_windows(many, 100.0, 20.0).schema == hours.schema
    after = {(r.event_type, r.start): r.leverage for r in live.latch_states(days).collect()}
    assert set(after.values()) == {0.0, 3.0}


def test_latch_summary_composes(spark):
    at = lambda m, v, i=0: (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1, "a", float(v), "")
    e = spark.createDataFrame([at(0, 150), at(0, 10, 1), at(0, 150, 2), at(20, 50), at(59, 150), at(70, 150), at(140, 5), at(141, 5), at(142, 200)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    w = live.latch_windows(e, 100.0, 20.0)
    assert [(r.first.state, r.last.state, r.n, r.before, r.after) for r in live.latch_states(w).orderBy("start").collect()] == [(1, 1, 4, 0, 1), (1, 1, 1, 1, 1), (0, 1, 3, 1, 1)]
    s = live.latch_switches(w, live.crossings(e, 100.0, 20.0)).orderBy("ts").collect()
    assert sorted((r.ts.hour * 60 + r.ts.minute, r.state) for r in s) == [(0, 0), (0, 1), (0, 1), (140, 0), (142, 1)]


def timed_parts(spark, sf_dir, how):
    timed = live.with_timers(spark)
    path = scratch(timed, "events")
    e = batch_events(timed, sf_dir)
    for k in range(4):
        part = e.where(F.dayofmonth("ts").between(8 * k, 8 * k + 7)) if how == "days" else e.where(F.col("event_id") % 4 == k)
        part.coalesce(1).write.mode("append").parquet(path)
    return timed.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_silences_are_alarmed_once(spark, sf_dir):
    by = ["event_type", "user_id"]
    want = rows(live.silences(batch_events(spark, sf_dir), by, 72.0))
    got = live.settle(live.silence_alarms(timed_parts(spark, sf_dir, "days"), by, 72.0), [], mode="append", name="alarms")
    assert rows(got) == want and want


def test_rows_without_a_time_raise_no_alarm(spark):
    timed = live.with_timers(spark)
    path = scratch(timed, "untimed")
    day = dt.datetime(2024, 1, 1)
    data = [("a", None), ("b", day), ("b", None), ("b", day + dt.timedelta(days=9)), ("c", day + dt.timedelta(days=20))]
    timed.createDataFrame(data, "source string, ts timestamp").coalesce(1).write.parquet(path)
    stream = timed.readStream.schema("source string, ts timestamp").parquet(path)
    got = live.settle(live.silence_alarms(stream, ["source"], 72.0), [], mode="append", name="untimed-alarms").collect()
    assert sorted((r.source, r.last.day) for r in got) == [("b", 1), ("b", 10)]


class Handle:
    """State and timer of one source; counts the calls, each of which is a round trip to the state store."""

    def __init__(self):
        self.held, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


def test_a_source_takes_few_calls_and_no_frames():
    handle, kind = Handle(), live._alarms(1.0, "eventTime", ["source"])
    kind.init(handle)
    at = lambda *hours: [Row(source="a", ts=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)) for h in hours]
    alarms = lambda *hours: [r.last.hour for r in kind.handleInputRows(("a",), iter(at(*hours)), None)]
    assert alarms(0, 2, 2.5) == [0] and handle.calls == 3
    # a timer that is still set is replaced without being looked for
    assert alarms(3, 5) == [3] and handle.calls == 7 and len(handle.timers) == 1
    assert alarms(4) == [] and handle.calls == 8
    # once the timer has raised the alarm, the next row raises none for the same silence
    handle.timers.clear()
    assert [r.last.hour for r in kind.handleExpiredTimer(("a",), None, None)] == [5]
    assert alarms(9) == [] and len(handle.timers) == 1


def test_processing_time_timer_alarms(spark):
    """A source that brings nothing more is overdue by the clock, without any later row."""
    timed = live.with_timers(spark)
    path, out = scratch(timed, "quiet"), scratch(timed, "quiet-out")
    schema = "ts timestamp, source string"
    timed.createDataFrame([(dt.datetime(2024, 1, 1), "a"), (dt.datetime(2024, 1, 1, 1), "b")], schema).coalesce(1).write.parquet(path)
    alarms = live.silence_alarms(timed.readStream.schema(schema).parquet(path), ["source"], 2 / 3600, clock="processingTime")
    q = alarms.writeStream.outputMode("append").option("checkpointLocation", scratch(timed, "quiet-ckpt")).format("parquet").option("path", out).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and len(found(timed, out)) < 2:
            time.sleep(1)
        assert found(timed, out) == ["a", "b"]
    finally:
        q.stop()


def found(spark, path):
    try:
        return sorted(r.source for r in spark.read.schema("source string, last timestamp, due timestamp").parquet(path).collect())
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def test_sessions_come_once_when_they_close(spark, sf_dir):
    want = rows(live.closed_sessions(batch_events(spark, sf_dir)))
    got = live.settle(live.sessions(parts(spark, sf_dir)), [], mode="append", name="sessions")
    assert rows(got) == want and want


def jittered_parts(spark, sf_dir):
    """Files of about eight days that reach up to three days into each other."""
    path = scratch(spark, "events")
    e = batch_events(spark, sf_dir).withColumn("__f", F.floor((F.dayofmonth("ts") - 1 + F.col("event_id") % 4) / 8))
    for k in range(5):
        e.where(F.col("__f") == k).drop("__f").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.drop("__f").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_with_out_of_order_rows(spark, sf_dir):
    """Rows that come days late still join their session while the watermark waits; each session comes once and whole."""
    got = live.settle(live.sessions(jittered_parts(spark, sf_dir), late="4 days"), [], mode="append", name="sessions")
    want = rows(live.closed_sessions(batch_events(spark, sf_dir), late_hours=96.0))
    assert rows(got) == want and want


def test_revisions_keep_the_newest(spark, sf_dir):
    want = live.revisions(batch_events(spark, sf_dir))
    got = live.settle(live.revisions(parts(spark, sf_dir)), ["user_id", "d"])
    assert rows(got.select(want.columns)) == rows(want)
