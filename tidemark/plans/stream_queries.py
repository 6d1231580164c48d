"""Streaming queries over events; oracles state the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import market
from tidemark.streaming import live

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
T = "'%Y-%m-%d %H:%M:%S'"


@query(
    "ST1 tumbling hourly bars from ticks with a watermark",
    f"SELECT event_type, strftime(date_trunc('hour',ts),{T}) AS start, arg_min(value,{{ts: ts, id: event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value,{{ts: ts, id: event_id}}) AS close, round(avg(value),8) AS mean, count(*) AS n FROM events GROUP BY 1,2",
)
def stream_hourly_bars(spark, sf):
    b = live.settle(live.tumbling_bars(live.event_stream(spark, sf)), ["event_type", "start"], name="bars")
    return b.select("event_type", stamp("start").alias("start"), "open", "high", "low", "close", F.round("mean", 8).alias("mean"), "n")


@query(
    "ST2 live latch per key in keyed state",
    f"""WITH l AS (SELECT event_type, ts, event_id, coalesce(last_value(CASE WHEN value>100 THEN 1 WHEN value<20 THEN 0 END IGNORE NULLS) OVER w,0) AS st FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
    SELECT event_type, strftime(ts,{T}) AS ts, CAST(st AS INT) AS state FROM (SELECT *, lag(st,1,0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM l) WHERE st<>p""",
)
def stream_latch(spark, sf):
    w = live.settle(live.latch_windows(live.event_stream(spark, sf), 100.0, 20.0), ["event_type", "start"], name="latch")
    c = live.settle(live.crossings(live.event_stream(spark, sf), 100.0, 20.0), [], mode="append", name="crossings")
    return live.latch_switches(w, c).select("event_type", stamp("ts").alias("ts"), "state")


@query(
    "ST2 E1 latch and leverage state per key at the end of every day, from merged hourly summaries",
    f"""WITH c AS (SELECT event_type, ts, event_id, CASE WHEN value>100 THEN 1 WHEN value<20 THEN 0 END AS st FROM events WHERE value>100 OR value<20),
    g AS (SELECT event_type, date_trunc('day',ts) AS d, count(*) AS n, arg_min(st,{{ts: ts, id: event_id}}) AS f, arg_max(st,{{ts: ts, id: event_id}}) AS l FROM c GROUP BY 1,2)
    SELECT event_type, strftime(d,{T}) AS start, n, f AS first_state, coalesce(lag(l) OVER (PARTITION BY event_type ORDER BY d),0) AS before, l AS after, CASE WHEN l=1 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END AS leverage FROM g""",
)
def stream_latch_states(spark, sf):
    w = live.settle(live.latch_windows(live.event_stream(spark, sf), 100.0, 20.0), ["event_type", "start"], name="latch")
    s = live.latch_states(live.merge_windows(w, "1 day"))
    return s.select("event_type", stamp("start").alias("start"), "n", F.col("first.state").alias("first_state"), "before", "after", "leverage")


@query(
    "ST3 Q6 staleness alarm per source",
    f"WITH p AS (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1,2), m AS (SELECT max(ts) AS mx FROM events) SELECT event_type, user_id, strftime(last,{T}) AS last, round((epoch_us(mx)-epoch_us(last))/3.6e9::DOUBLE,6) AS age_hours, (epoch_us(mx)-epoch_us(last))/3.6e9::DOUBLE>72 AS stale FROM p JOIN m ON TRUE",
)
def source_staleness(spark, sf):
    e = market.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = live.staleness(e, ["event_type", "user_id"], 72.0)
    return s.select("event_type", "user_id", stamp("last").alias("last"), F.round("age_hours", 6).alias("age_hours"), "stale")


@query(
    "ST4 late revisions: newest value per user and day wins",
    "SELECT user_id, strftime(CAST(ts AS DATE),'%Y-%m-%d') AS d, arg_max(value,{ts: ts, id: event_id}) AS value, count(*) AS n FROM events GROUP BY 1,2",
)
def stream_revisions(spark, sf):
    r = live.settle(live.revisions(live.event_stream(spark, sf)), ["user_id", "d"], name="revisions")
    return r.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "value", "n")


@query(
    "ST5 sliding windows with a live z-score",
    f"""WITH x AS (SELECT event_type, event_id, value, ts, unnest([CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) - k*INTERVAL 6 HOUR FOR k IN [0,1,2,3]]) AS s FROM events)
    SELECT event_type, strftime(s,{T}) AS start, round(avg(value),8) AS mean, round(stddev_samp(value),8) AS sd, round((arg_max(value,{{ts: ts, id: event_id}})-avg(value))/nullif(stddev_samp(value),0),6) AS z, count(*) AS n FROM x GROUP BY 1,2""",
)
def stream_sliding_scores(spark, sf):
    s = live.settle(live.sliding_stats(live.event_stream(spark, sf)), ["event_type", "start"], name="sliding")
    return s.select("event_type", stamp("start").alias("start"), F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("z", 6).alias("z"), "n")


@query(
    "ST5 activity sessions per user",
    f"""WITH g AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, strftime(min(ts),{T}) AS start, strftime(max(ts)+INTERVAL 6 HOUR,{T}) AS "end", count(*) AS n, round(sum(value),4) AS total FROM s GROUP BY user_id, sid""",
)
def event_sessions(spark, sf):
    e = market.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = live.sessions(e)
    return s.select("user_id", stamp("start").alias("start"), stamp("end").alias("end"), "n", F.round("total", 4).alias("total"))


@query(
    "ST3 live alarm for each silence of a source, from keyed state with timers",
    f"""WITH e AS (SELECT event_type, user_id, ts, lead(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS nxt FROM events), m AS (SELECT max(ts)-INTERVAL 2 HOUR AS mark FROM events)
    SELECT event_type, user_id, strftime(ts,{T}) AS last, strftime(ts+INTERVAL 72 HOUR,{T}) AS due FROM e JOIN m ON TRUE WHERE ts+INTERVAL 72 HOUR<nxt OR (nxt IS NULL AND ts+INTERVAL 72 HOUR<mark)""",
)
def stream_silence_alarms(spark, sf):
    timed = live.with_timers(spark)
    a = live.settle(live.silence_alarms(live.event_stream(timed, sf), ["event_type", "user_id"], 72.0), [], mode="append", name="alarms")
    return a.select("event_type", "user_id", stamp("last").alias("last"), stamp("due").alias("due"))


@query(
    "ST5 sessions emitted once, when the watermark closes them",
    f"""WITH g AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), m AS (SELECT max(ts)-INTERVAL 2 HOUR AS mark FROM events)
    SELECT user_id, strftime(min(ts),{T}) AS start, strftime(max(ts)+INTERVAL 6 HOUR,{T}) AS "end", count(*) AS n, round(sum(value),4) AS total FROM s GROUP BY user_id, sid HAVING max(ts)+INTERVAL 6 HOUR<=(SELECT mark FROM m)""",
)
def stream_sessions(spark, sf):
    s = live.settle(live.sessions(live.event_stream(spark, sf)), [], mode="append", name="sessions")
    return s.select("user_id", stamp("start").alias("start"), stamp("end").alias("end"), "n", F.round("total", 4).alias("total"))
