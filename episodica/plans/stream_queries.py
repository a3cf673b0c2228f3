"""Queries that run as streams over the event file (or feeds Spark derives from it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import events, replay, reward
from episodica.plans.domain_queries import sql_stamp, stamp
from episodica.plans.episode_queries import FOLD, joined, with_relevant
from episodica.plans.event_queries import KEPT, MAPPED, WINDOWED
from episodica.plans.registry import query
from episodica.session import fresh_dir
from episodica.sources import bindings, files
from episodica.sources.tables import table
from episodica.streaming import backlog, jobs
from episodica.streaming.replay import stream_replay


# An episode lasts a week at most, so after two weeks nothing of it is to come.
IDLE_SECONDS = 14 * 86_400


def _feed(spark, folder):
    """The event table as a feed in order of event time: one file, or a folder of part files."""
    return backlog.Backlog(spark, f"{folder}/events.parquet*", backlog.SLICE_BYTES)


def _kept(feed):
    """Filtered and mapped feed. The watermark follows the rows kept, not the ones dropped."""
    return events.filter_map(feed.rows(), KEPT).withWatermark("ts", "10 seconds")


def _ntz(df, *names):
    return df.withColumns({n: stamp(F.col(n)) for n in names})


@query("stream_source", f"SELECT event_id, user_id, event_type, value, {sql_stamp('ts')} AS ts FROM events")
def stream_source(spark, folder):
    feed = _feed(spark, folder)
    out = feed.drain(feed.rows("10 seconds"))
    return _ntz(out.select("event_id", "user_id", "event_type", "value", "ts"), "ts")


@query(
    "stream_tumbling",
    f"""WITH {MAPPED} SELECT {sql_stamp("time_bucket(INTERVAL '5 minutes', ts)")} AS window_start,
          {sql_stamp("time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes'")} AS window_end, user_id, {WINDOWED}
        FROM m WHERE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes'
          <= (SELECT max(ts) - INTERVAL '10 seconds' FROM m) GROUP BY ALL""",
)
def stream_tumbling(spark, folder):
    """Closed five-minute windows of the filtered feed."""
    feed = _feed(spark, folder)
    return _ntz(feed.drain(jobs.tumbling(_kept(feed), ["user_id"], "5 minutes")), "window_start", "window_end")


@query(
    "stream_late",
    """WITH b AS (SELECT *, time_bucket(INTERVAL '1 day', ts) AS s FROM events),
       w AS (SELECT max(ts) - INTERVAL '10 seconds' AS mark FROM b WHERE event_type <> 'view'),
       e AS (SELECT max(ts) - INTERVAL '10 seconds' AS mark FROM b)
       SELECT strftime(s, '%Y-%m-%d') AS day, count(*) AS events
       FROM b WHERE (event_type <> 'view' OR s + INTERVAL '1 day' > (SELECT mark FROM w))
         AND s + INTERVAL '1 day' <= (SELECT mark FROM e) GROUP BY 1""",
)
def stream_late(spark, folder):
    """The views arrive after the watermark has passed most of their windows: those are lost.

    The same stream runs twice over its feed, before and after the views are added, and
    goes on from its saved progress.
    """
    feed, place = fresh_dir(spark, "feed"), jobs.new_place(spark)
    rows = table(spark, folder, "events")
    for number, late in enumerate((F.col("event_type") != "view", F.col("event_type") == "view")):
        rows.where(late).write.parquet(f"{feed}/part={number}")
        stream = jobs.event_source(spark, f"{feed}/*", delay="10 seconds")
        counts = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"))
        out = jobs.drain(counts.select(F.col("w.start").alias("day"), "events"), place)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events")


@query(
    "stream_late_rows",
    f"""SELECT event_id, user_id, event_type, value, {sql_stamp('ts')} AS ts FROM events
        WHERE event_type = 'view' AND time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day'
          <= (SELECT max(ts) - INTERVAL '10 seconds' FROM events WHERE event_type <> 'view')""",
)
def stream_late_rows(spark, folder):
    """The views that ``stream_late`` loses, from the side table of late rows."""
    feed, late, progress = fresh_dir(spark, "feed"), fresh_dir(spark, "late"), fresh_dir(spark, "progress")
    rows = table(spark, folder, "events")
    for number, wanted in enumerate((F.col("event_type") != "view", F.col("event_type") == "view")):
        rows.where(wanted).write.parquet(f"{feed}/part={number}")
        stream = jobs.event_source(spark, f"{feed}/*")
        jobs.drain_batches(stream, backlog.late_writer(late, "1 day", "10 seconds"), progress=progress)
    kept = backlog.read_batches(spark, f"{late}/late", jobs.FEED_SCHEMA.replace("TIMESTAMP_NTZ", "TIMESTAMP"))
    return _ntz(kept.select("event_id", "user_id", "event_type", "value", "ts"), "ts")


@query(
    "stream_dedup",
    """SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def stream_dedup(spark, folder):
    """The first event of a user, type and day; a day's keys go once it lies a day back."""
    feed = _feed(spark, folder)
    rows = feed.rows("1 day").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = feed.drain(jobs.dedup(rows, ["user_id", "event_type", "day"]))
    return out.select("user_id", "event_type", "day")


JOINED = """SELECT l.event_id AS view_id, r.event_id AS purchase_id, l.user_id FROM events l JOIN events r
    ON l.user_id = r.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL '6 hours'
    WHERE l.event_type = 'view' AND r.event_type = 'purchase'"""


@query("stream_join_within", JOINED)
def stream_join_within(spark, folder):
    """Views followed by a purchase of the same user within six hours."""
    feed = _feed(spark, folder)
    views = feed.rows("10 seconds").where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    buys = feed.rows("10 seconds").where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    pairs = jobs.join_within(views, buys, "user_id", 21_600)
    return feed.drain(pairs.select("view_id", "purchase_id", F.col("l.user_id").alias("user_id")))


@query("join_within", JOINED)
def join_within(spark, folder):
    """The same join in batch, by a sweep in time order."""
    rows = table(spark, folder, "events")
    views = rows.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("viewed"))
    buys = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
    return events.join_within(views, buys, "user_id", "viewed", "bought", 21_600).select("view_id", "purchase_id", "user_id")


@query(
    "stream_replay",
    FOLD
    + """SELECT episode_id, task_id, array_to_string(loaded, ',') AS loaded, array_to_string(ever, ',') AS ever,
           (SELECT min(step) FROM a WHERE a.episode_id = rewards.episode_id AND kind = 'submit') AS steps,
           round(reward, 9) AS reward FROM rewards""",
)
def stream_replay_query(spark, folder):
    """Rewards of submitted episodes from a stream of actions."""
    feed = _feed(spark, folder)
    actions = bindings.actions_of(feed.rows("10 seconds"))
    setting = replay.settings(bindings.episodes(spark, folder), bindings.tasks(spark, folder))
    out = feed.drain(stream_replay(actions, setting, IDLE_SECONDS)).where("status = 'done'")
    return reward.with_reward(with_relevant(out, spark, folder)).select(
        "episode_id", "task_id", joined("loaded").alias("loaded"), joined("ever").alias("ever"), "steps",
        F.round("reward", 9).alias("reward"),
    )


@query(
    "stream_branch",
    f"""WITH {MAPPED}, w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS s, user_id, {WINDOWED} FROM m
          WHERE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '10 seconds' FROM m)
          GROUP BY ALL)
        SELECT CASE WHEN total_value > 100 THEN 'high_value' ELSE 'default' END AS route, user_id, action_count, total_value FROM w""",
)
def stream_branch(spark, folder):
    """Filter, map, window, then each result to the sink of its route."""
    sinks, feed = fresh_dir(spark, "routes"), _feed(spark, folder)
    rows = jobs.tumbling(_kept(feed), ["user_id"], "5 minutes")
    feed.drain_batches(rows, files.branch_writer({"high_value": F.col("total_value") > 100.0}, sinks))
    fields = "user_id long, action_count long, total_value double, batch int, route string"
    return files.read_sink(spark, sinks, fields).select("route", "user_id", "action_count", "total_value")


@query(
    "alert_stream",
    f"""WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS s, count(*) AS events,
                     avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate FROM events
                   WHERE time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' <= (SELECT max(ts) - INTERVAL '10 seconds' FROM events)
                   GROUP BY 1)
        SELECT {sql_stamp('s')} AS window_start, events, round(error_rate, 6) AS error_rate FROM w WHERE error_rate > 0.01""",
)
def alert_stream(spark, folder):
    """One-minute windows whose error rate is above one percent, from the alert sink."""
    sinks, feed = fresh_dir(spark, "alerts"), _feed(spark, folder)
    rates = jobs.error_rates(feed.rows("10 seconds"), "1 minute", F.col("event_type") == "error")
    feed.drain_batches(rates, files.branch_writer({"alert": F.col("error_rate") > 0.01}, sinks))
    fields = "window_start timestamp, events long, errors long, sketch binary, error_rate double, batch int, route string"
    alerts = files.read_sink(spark, sinks, fields).where("route = 'alert'")
    return _ntz(alerts.select("window_start", "events", F.round("error_rate", 6).alias("error_rate")), "window_start")
