"""Structured Streaming: live bars, latches, staleness, revisions, sliding scores, sessions.

Each function takes a streaming (or batch) DataFrame and returns the transformed
one, so batch and stream share one definition. ``settle`` drives a stream to a
table in the shared folder and reads the final version of each key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import scratch
from tidemark.sources.market import SCHEMAS

def at() -> Column:
    """Order of events; equal times go by id."""
    return F.struct("ts", "event_id")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close, mean and count per (window, event_type)."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(
            F.min_by("value", at()).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at()).alias("close"),
            F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"),
        )
        .select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "mean", "n")
    )


def sliding_stats(events: DataFrame, size: str = "24 hours", slide: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Mean, deviation and last-value z-score over overlapping windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    g = g.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max_by("value", at()).alias("last"), F.count(F.lit(1)).alias("n"))
    z = (F.col("last") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return g.select("event_type", F.col("w.start").alias("start"), "mean", "sd", z.alias("z"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Activity sessions per user: closed after ``gap`` without an event."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def crossings(events: DataFrame, trigger: float, recover: float) -> DataFrame:
    """Rows beyond a threshold, as latch state 1 or 0. Rows between never move a latch."""
    side = F.when(F.col("value") > trigger, 1).when(F.col("value") < recover, 0)
    return events.withColumn("state", side).where("state is not null").select("event_type", "ts", "event_id", "state")


def latch_windows(events: DataFrame, trigger: float, recover: float, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Summary of the threshold crossings of each (window, event_type): first, last and their number.

    A crossing sets or clears a latch whatever it was, so a window acts on it as its last crossing does and a window
    without one holds it. The state is three values however many rows come, and a late row within the watermark revises its window only.
    """
    c = crossings(events.withWatermark("ts", late), trigger, recover)
    g = c.groupBy(F.window("ts", size).alias("w"), "event_type").agg(*_first_and_last(F.struct("ts", "event_id", "state"), F.struct("ts", "event_id", "state"), F.count(F.lit(1))))
    return g.select("event_type", F.col("w.start").alias("start"), "first", "last", "n")


def _first_and_last(first: Column, last: Column, n: Column) -> list[Column]:
    # structs compare by ts, then event_id
    return [F.min(first).alias("first"), F.max(last).alias("last"), n.alias("n")]


def merge_windows(windows: DataFrame, size: str) -> DataFrame:
    """Summaries of longer windows from those of their parts; the order of merging does not matter."""
    g = windows.groupBy("event_type", F.window("start", size).alias("w")).agg(*_first_and_last(F.col("first"), F.col("last"), F.sum("n")))
    return g.select("event_type", F.col("w.start").alias("start"), "first", "last", "n")


def latch_states(windows: DataFrame, leverage: tuple[float, float] = (3.0, 0.0)) -> DataFrame:
    """State that each window finds and leaves, from 0, and the leverage held from its end on: ``leverage[state]``."""
    w = Window.partitionBy("event_type").orderBy("start")
    s = windows.withColumn("after", F.col("last.state")).withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))
    return s.withColumn("leverage", F.when(F.col("after") == 1, F.lit(leverage[1])).otherwise(F.lit(leverage[0])))


def latch_switches(windows: DataFrame, crossed: DataFrame, size: str = "1 hour") -> DataFrame:
    """Every time the latch of an event type changes.

    Inside a window a crossing is compared with the one before it, the first one with the state that the window finds;
    the rows of one window are sorted together, never those of an event type. Windows whose crossings were one and agree with what
    they find are left out before that.
    """
    found = latch_states(windows).where((F.col("n") > 1) | (F.col("first.state") != F.col("before"))).select("event_type", "start", "before")
    c = crossed.withColumn("start", F.window("ts", size)["start"]).join(found, ["event_type", "start"])
    before = F.coalesce(F.lag("state").over(Window.partitionBy("event_type", "start").orderBy("ts", "event_id")), F.col("before"))
    return c.withColumn("__b", before).where(F.col("state") != F.col("__b")).select("event_type", "ts", "state")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """A session like this one whose streams keep state in RocksDB, which processors with timers need."""
    other = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return other


def settle(stream: DataFrame, keys: list[str], mode: str = "update", name: str = "stream") -> DataFrame:
    """Run all available input; batch b's rows are appended with ``batch_id`` = b, the last one per key wins.

    A replayed batch rewrites its own folder, so the sink is idempotent.
    """
    spark = stream.sparkSession
    out, ckpt = scratch(spark, name), scratch(spark, name + "-ckpt")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(f"{schema}, batch_id int").parquet(out)
    if not keys:
        return rows.drop("batch_id")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def staleness(source: DataFrame, by: list[str], limit_hours: float) -> DataFrame:
    """Age of every source's newest row against the newest row overall."""
    per = source.groupBy(*by).agg(F.max("ts").alias("last"))
    newest = source.agg(F.max("ts").alias("newest")).withColumn("__k", F.lit(1))
    age = (F.unix_micros("newest") - F.unix_micros("last")) / 3.6e9
    x = per.withColumn("__k", F.lit(1)).join(F.broadcast(newest), "__k").withColumn("age_hours", age)  # newest: one row
    return x.select(*by, "last", "age_hours", (F.col("age_hours") > limit_hours).alias("stale"))


#: One alarm for each silence: the source, its last row before it, and when it was due
ALARM = "last timestamp, due timestamp"


def _alarms(limit_hours: float, clock: str, by: list[str]):
    """Processor that keeps the newest time of a source and a timer at which it is overdue.

    It works on rows and plain numbers: a source brings few rows at a time, so a frame for each would cost more than the work.
    Rows without a time take no part; times without a zone count as UTC.
    """
    from pyspark.sql.streaming import StatefulProcessor

    limit = dt.timedelta(hours=limit_hours)
    micro = dt.timedelta(microseconds=1)
    limit_us = limit // micro
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    alarm = Row(*by, "last", "due")

    def micros(t: dt.datetime) -> int:
        return ((t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)) - epoch) // micro

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("last", "last long, timer long, alarmed boolean")

        def handleInputRows(self, key, rows, timerValues):
            ts = sorted([micros(r.ts) for r in rows if r.ts is not None])
            if not ts:
                return
            held = self.state.get()
            if held is not None:
                last, timer, alarmed = held
                # late rows cannot end a silence, and one that had its alarm has no second
                if ts[-1] <= last:
                    return
                ts = [t for t in ts if t > last]
                if not alarmed:
                    self.handle.deleteTimer(timer)
                    ts = [last, *ts]
            if clock == "eventTime":
                timer = (ts[-1] + limit_us) // 1000 + 1
            else:
                timer = timerValues.getCurrentProcessingTimeInMs() + limit_us // 1000
            self.handle.registerTimer(timer)
            self.state.update((ts[-1], timer, False))
            for a, b in zip(ts, ts[1:]):
                if b - a > limit_us:
                    yield self._alarm(key, a)

        def _alarm(self, key, last: int) -> Row:
            t = epoch + last * micro
            return alarm(*key, t, t + limit)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last, timer, _ = self.state.get()
            self.state.update((last, timer, True))
            yield self._alarm(key, last)

        def close(self) -> None:
            pass

    return Silence()


def silence_alarms(events: DataFrame, by: list[str], limit_hours: float, clock: str = "eventTime", late: str = "2 hours") -> DataFrame:
    """An alarm each time a source has been silent for longer than the limit, from keyed state with a timer per source.

    With event time, a silence counts once the watermark passes its end, or when the source's next row shows it; replays give the
    same alarms however rows are batched, as long as rows are not late. With processing time the timer runs from when the newest row
    came. State is two times and one flag for each source. Needs the RocksDB state store.
    """
    schema = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in by) + ", " + ALARM
    e = events.withWatermark("ts", late) if clock == "eventTime" else events
    return e.select(*by, "ts").groupBy(*by).transformWithState(_alarms(limit_hours, clock, by), schema, "Append", clock)


def silences(events: DataFrame, by: list[str], limit_hours: float, late_hours: float = 2.0) -> DataFrame:
    """The same alarms from a table: gaps between a source's rows, and last rows that the watermark has passed by the limit."""
    w = Window.partitionBy(*by).orderBy("ts")
    limit = F.make_interval(secs=F.lit(limit_hours * 3600))
    end = events.agg((F.max("ts") - F.make_interval(secs=F.lit(late_hours * 3600))).alias("mark")).withColumn("__k", F.lit(1))
    g = events.select(*by, "ts").withColumn("nxt", F.lead("ts").over(w)).withColumn("__k", F.lit(1)).join(F.broadcast(end), "__k")  # end: one row
    due = F.col("ts") + limit
    return g.where((due < F.col("nxt")) | (F.col("nxt").isNull() & (due < F.col("mark")))).select(*by, F.col("ts").alias("last"), due.alias("due"))


def closed_sessions(events: DataFrame, gap: str = "6 hours", late_hours: float = 2.0) -> DataFrame:
    """Sessions of a table that a stream over all of it has closed: ended at or before its watermark."""
    end = events.agg((F.max("ts") - F.make_interval(secs=F.lit(late_hours * 3600))).alias("mark")).withColumn("__k", F.lit(1))
    s = sessions(events, gap).withColumn("__k", F.lit(1)).join(F.broadcast(end), "__k")  # end: one row
    return s.where(F.col("end") <= F.col("mark")).drop("__k", "mark")


def revisions(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Newest value per (user, day); later events revise earlier ones until the watermark passes the day."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w"))
    out = g.agg(F.max_by("value", at()).alias("value"), F.max("ts").alias("version"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.to_date("w.start").alias("d"), "value", "version", "n")
