"""Streams against their batch twins, late and undecodable rows, payload codecs."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from episodica.operators import events, replay
from episodica.session import fresh_dir, prepare
from episodica.sources import codecs, files
from episodica.streaming import jobs
from episodica.streaming.replay import stream_replay

T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, rows, part):
    schema = "event_id long, minute int, user_id long, event_type string, value double"
    df = spark.createDataFrame(rows, schema).withColumn("ts", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minute"))))
    df.withColumn("props", F.lit("{}")).drop("minute").coalesce(1).write.parquet(f"{folder}/part={part}")


def test_dedup_inside_and_outside_the_span(spark):
    prepare(spark)
    folder, place = fresh_dir(spark, "feed"), jobs.new_place(spark)
    feed(spark, folder, [(1, 0, 7, "a", 1.0), (2, 5, 7, "a", 1.0), (3, 100, 8, "a", 1.0)], 1)
    run = lambda: jobs.drain(jobs.dedup(jobs.event_source(spark, f"{folder}/*", delay="10 minutes"), ["user_id"]), place)
    assert {r.event_id for r in run().collect()} in ({1, 3}, {2, 3})
    feed(spark, folder, [(4, 200, 7, "a", 1.0), (5, 205, 7, "a", 1.0)], 2)
    assert len(run().collect()) == 3
    batch = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), 7) for i, m in ((1, 0), (2, 5), (3, 12), (4, 30))], "id int, ts timestamp, k int")
    for slice_rows in (1, 100):
        kept = events.dedup_within(batch, ["k"], ["ts", "id"], 600, slice_rows)
        assert sorted(r.id for r in kept.collect()) == [1, 4]


def test_stream_replay_and_abandoned_episode(spark):
    """One episode over two runs; another one times out without a submit."""
    prepare(spark)
    folder, place = fresh_dir(spark, "feed"), jobs.new_place(spark)
    episodes = spark.createDataFrame([("1", "t", 2), ("2", "t", 2)], "episode_id string, task_id string, context_budget int")
    tasks = spark.createDataFrame([("t", ["a", "b"], ["c"])], "task_id string, relevant array<string>, distractors array<string>")

    def run():
        rows = jobs.event_source(spark, f"{folder}/*", delay="10 minutes")
        actions = rows.select(
            F.col("user_id").cast("string").alias("episode_id"), "ts", "event_id",
            F.split("event_type", ":")[0].alias("action_type"), F.split("event_type", ":")[1].alias("skill_id"),
            (F.col("value") > 0).alias("correct"),
        )
        return jobs.drain(stream_replay(actions, replay.settings(episodes, tasks), idle_seconds=3600), place)

    feed(spark, folder, [(1, 0, 1, "load:a", 0.0), (2, 1, 1, "invoke:c", 0.0), (3, 2, 1, "load:b", 0.0), (4, 3, 2, "load:b", 0.0), (5, 4, 2, "load:z", 0.0)], 1)
    assert run().count() == 0
    # The third action of batch two comes after the submit, in the same batch: it changes nothing.
    feed(spark, folder, [(6, 20, 1, "unload:c", 0.0), (7, 21, 1, "submit:", 1.0), (8, 22, 1, "load:b", 0.0)], 2)
    row = run().first()
    assert (row.episode_id, row.steps, row.loaded, row.ever, row.done, row.correct) == ("1", 5, ["a"], ["a", "c"], True, True)
    feed(spark, folder, [(9, 300, 3, "load:a", 0.0)], 3)
    left = run().where("status = 'abandoned'").collect()
    assert [(r.episode_id, r.steps, r.loaded) for r in left] == [("2", 2, ["b"])]


def test_routes_are_whole_and_disjoint(spark):
    prepare(spark)
    folder = fresh_dir(spark, "routes")
    df = spark.range(10).withColumnRenamed("id", "v")
    write = files.branch_writer({"high": F.col("v") > 7, "mid": F.col("v") > 4}, folder)
    for _ in range(2):  # a batch that runs again leaves no copies
        write(df, 0)
    got = spark.read.schema("v long, batch int, route string").parquet(folder).collect()
    assert {(r.v, r.route) for r in got} == {(v, "high" if v > 7 else "mid" if v > 4 else "default") for v in range(10)}
    assert len(got) == 10


def test_dead_letters(spark):
    prepare(spark)
    texts = ['{"a": 1}', '{"a": "x"}', "{", "", None, "[]", '{"b": 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good, bad = files.dead_letters(df, "t", "a INT")
    assert sorted(r.i for r in good.collect()) == [0, 6]
    assert sorted(r.i for r in bad.collect()) == [1, 2, 3, 4, 5]


def test_payload_defaults(spark):
    prepare(spark)
    df = spark.createDataFrame([("{}",)], "p string")
    seen = codecs.with_observation(df, "p").first().observation
    assert (seen.difficulty, seen.context_budget_total, seen.remaining_invocations) == ("easy", 5, 0)
    assert seen.messages == [] and seen.loaded_skill_contents == {} and seen.done is False and seen.reward is None
    state = codecs.with_state(df, "p").first().state
    assert (state.remaining_invocations, state.step_count, state.episode_id) == (5, 0, None)
    actions = spark.createDataFrame([("load", "s", None), ("submit", None, "x"), ("load", "", None)], "action_type string, skill_id string, answer string").coalesce(1)
    assert [r[0] for r in actions.select(codecs.action_json()).collect()] == [
        '{"action_type":"load","skill_id":"s"}', '{"action_type":"submit","answer":"x"}', '{"action_type":"load","skill_id":""}',
    ]


def test_join_within_edges(spark):
    prepare(spark)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("k", 1, at(0)), ("k", 2, at(59)), ("j", 3, at(0))], "k string, l int, lt timestamp")
    right = spark.createDataFrame([("k", 10, at(0)), ("k", 11, at(60)), ("k", 12, at(61)), ("k", 13, at(119))], "k string, r int, rt timestamp")
    got = {(r.l, r.r) for r in events.join_within(left, right, "k", "lt", "rt", 60).collect()}
    assert got == {(1, 10), (1, 11), (2, 11), (2, 12), (2, 13)}


def test_join_within_by_sweep_equals_brute_force(spark):
    """Several keys, ties, repeated rows, nulls, batches of a few rows, and a hot key in several tasks."""
    prepare(spark)
    draw = random.Random(3)
    keys = ["a", "b", "hot", None]
    some = lambda n: [(draw.choice(keys + ["hot"] * 4), i, None if draw.random() < 0.05 else T0 + dt.timedelta(seconds=draw.randrange(900))) for i in range(n)]
    lefts, rights = some(400), some(300)
    lefts += lefts[:20]
    left = spark.createDataFrame(lefts, "k string, l int, lt timestamp").repartition(3)
    right = spark.createDataFrame(rights, "k string, r int, rt timestamp").repartition(3)
    for span in (0, 60):
        want = sorted(
            (l, r) for k, l, s in lefts for j, r, t in rights
            if k is not None and k == j and s and t and 0 <= (t - s).total_seconds() <= span
        )
        for slice_rows, batch in ((1_000_000, 10_000), (10, 7)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            try:
                out = events.join_within(left, right, "k", "lt", "rt", span, slice_rows)
                assert sorted((r.l, r.r) for r in out.collect()) == want
                assert out.columns == ["k", "l", "lt", "r", "rt"]
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert events.join_within(left.limit(0), right, "k", "lt", "rt", 60).count() == 0
    assert events.join_within(left, right.limit(0), "k", "lt", "rt", 60).count() == 0


def test_join_within_sends_a_hot_key_to_several_tasks(spark):
    prepare(spark)
    left = spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("l"), F.timestamp_seconds(F.col("id")).alias("lt"))
    right = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("r"), F.timestamp_seconds(F.col("id") % 60).alias("rt"))
    out = events.join_within(left, right, "k", "lt", "rt", 60, 2_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(shares) > 2 and max(shares) < 0.7 * sum(shares)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = events.join_within(left, right, "k", "lt", "rt", 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_joins_a_lookup_too_large_to_broadcast(spark):
    from episodica.plans.skew import keyed_join

    prepare(spark)
    folder = fresh_dir(spark, "feed")
    feed(spark, folder, [(1, 0, 7, "a", 1.0), (2, 5, 8, "a", 1.0)], 1)
    users = spark.createDataFrame([(7, "x")], "user_id long, name string")
    rows = keyed_join(jobs.event_source(spark, f"{folder}/*"), users, ["user_id"])
    assert [(r.event_id, r.name) for r in jobs.drain(rows).collect()] == [(1, "x")]


def test_event_table_as_file_folder_and_slices_of_time(spark):
    """One file, and part files whose order says nothing about their times, cut into many slices, give the same."""
    from episodica.plans import load_all
    from episodica.plans.registry import QUERIES
    from episodica.streaming import backlog

    load_all()
    prepare(spark)
    small, parts = "/root/testdata/sf0.001", fresh_dir(spark, "parts")
    for name in "region nation customer supplier part orders lineitem".split():
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{parts}/{name}.parquet")
    spark.read.parquet(f"{small}/events.parquet").repartition(5).write.parquet(f"{parts}/events.parquet")
    bag = lambda df: sorted(map(str, df.collect()))
    names = ("stream_source", "stream_tumbling", "stream_dedup", "stream_join_within", "stream_replay")
    whole = {n: bag(QUERIES[n](spark, small)) for n in names}
    assert {n: bag(QUERIES[n](spark, parts)) for n in names[:1]} == {names[0]: whole[names[0]]}
    kept = backlog.SLICE_BYTES
    try:
        backlog.SLICE_BYTES = -(-backlog.file_bytes(spark, f"{parts}/events.parquet*") // 4)
        assert {n: bag(QUERIES[n](spark, parts)) for n in names} == whole
    finally:
        backlog.SLICE_BYTES = kept


def test_slices_of_time_are_disjoint_and_a_feed_goes_on(spark):
    """Ties share a slice, rows without a time come first, and a second driver goes on where the first one ended."""
    from episodica.streaming import backlog

    prepare(spark)
    folder = fresh_dir(spark, "ties")
    feed(spark, folder, [(i, None if i % 10 == 0 else i % 4, i, "view", 1.0) for i in range(200)], 0)
    size = backlog.file_bytes(spark, f"{folder}/*")
    assert size > 0 and backlog.file_bytes(spark, f"{folder}/none*") == 0
    made = backlog.Backlog(spark, f"{folder}/*", -(-size // 3))
    place = jobs.new_place(spark)
    jobs.drain(made.rows("10 seconds"), place)
    again = backlog.Backlog(spark, f"{folder}/*", -(-size // 3), folder=made.folder)
    out = again.drain(again.rows("10 seconds"), place)
    assert sorted(r.event_id for r in out.collect()) == list(range(200))
    spans = [spark.read.parquet(s).agg(F.min("ts"), F.max("ts"), F.count_if(F.isnull("ts"))).first() for s in sorted(
        str(f).rsplit("/", 1)[0] for f in spark.read.parquet(f"{made.folder}/shown/*").inputFiles())]
    spans = sorted(set((s[0], s[1]) for s in spans if s[0] is not None))
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert not again.advance()


def test_late_rows_are_kept_with_what_was_counted(spark):
    """Counted and late rows together are all rows; a replayed batch leaves no copies."""
    from episodica.streaming import backlog

    prepare(spark)
    folder, late = fresh_dir(spark, "late"), fresh_dir(spark, "side")
    feed(spark, folder, [(1, 0, 1, "view", 1.0), (2, 30, 1, "view", 1.0)], 0)
    write, progress, place = backlog.late_writer(late, "5 minutes", "10 seconds"), fresh_dir(spark, "progress"), jobs.new_place(spark)
    for part, rows in enumerate([[], [(3, 1, 1, "view", 1.0), (4, 29, 1, "view", 1.0), (5, 31, 1, "view", 1.0), (6, None, 1, "view", 1.0)], [(7, 99, 1, "view", 1.0)]]):
        if part:
            feed(spark, folder, rows, part)
        jobs.drain_batches(jobs.event_source(spark, f"{folder}/*"), write, progress=progress)
        counted = jobs.event_source(spark, f"{folder}/*", delay="10 seconds").groupBy(F.window("ts", "5 minutes")).count()
        out = jobs.drain(counted, place)
    side = lambda: sorted(r.event_id for r in backlog.read_batches(spark, f"{late}/late", jobs.FEED_SCHEMA.replace("_NTZ", "")).collect())
    assert side() == [3]  # the window of 4 ends after the mark of 29:50
    assert out.agg(F.sum("count")).first()[0] == 4  # 1, 2, 4 and 5; 6 has no time, the window of 7 is open
    batch = spark.read.parquet(f"{folder}/part=1").withColumn("ts", F.col("ts").cast("timestamp"))
    number = max(r.batch for r in backlog.read_batches(spark, f"{late}/late", "event_id long, batch int").where("event_id = 3").collect())
    write(batch, number)
    assert side() == [3]


def test_late_actions_open_no_second_episode(spark):
    prepare(spark)
    folder, place = fresh_dir(spark, "feed"), jobs.new_place(spark)
    episodes = spark.createDataFrame([("1", "t", 2), ("2", "t", 2)], "episode_id string, task_id string, context_budget int")
    tasks = spark.createDataFrame([("t", ["a", "b"], ["c"])], "task_id string, relevant array<string>, distractors array<string>")

    def run():
        rows = jobs.event_source(spark, f"{folder}/*", delay="10 minutes")
        actions = rows.select(
            F.col("user_id").cast("string").alias("episode_id"), "ts", "event_id", F.split("event_type", ":")[0].alias("action_type"),
            F.split("event_type", ":")[1].alias("skill_id"), (F.col("value") > 0).alias("correct"),
        )
        return jobs.drain(stream_replay(actions, replay.settings(episodes, tasks), idle_seconds=3600), place)

    feed(spark, folder, [(1, 0, 1, "load:a", 0.0), (2, 1, 1, "submit:", 1.0), (3, 1, 2, "load:b", 0.0)], 1)
    run()
    feed(spark, folder, [(4, 20, 1, "load:b", 0.0), (5, 21, 1, "submit:", 1.0)], 2)
    run()
    feed(spark, folder, [(6, 90, 3, "load:a", 0.0)], 3)
    run()
    feed(spark, folder, [(7, 95, 2, "submit:", 1.0), (8, 400, 3, "load:a", 0.0)], 4)
    got = sorted((r.episode_id, r.status, r.steps, tuple(r.loaded)) for r in run().where("episode_id < '3'").collect())
    assert got == [("1", "done", 2, ("a",)), ("1", "late", 2, ()), ("2", "abandoned", 1, ("b",)), ("2", "late", 1, ())]


def test_empty_sink_is_empty(spark):
    prepare(spark)
    assert files.read_sink(spark, fresh_dir(spark, "none"), "a int, route string").count() == 0


def test_distinct_counts_are_chained_aggregates(spark):
    """Windows in a stream equal those of a table, also where the step does not divide the width."""
    prepare(spark)
    folder, rng = fresh_dir(spark, "feed"), random.Random(3)
    rows = [(i, rng.randrange(600), i % 3, rng.choice(["a", "b", "c", None]), rng.choice([0.25, 1.5, None])) for i in range(3000)]
    feed(spark, folder, rows, 1)
    feed(spark, folder, [(9999, 9000, 1, "z", 1.0)], 2)  # closes all windows before it
    for width, step in (("30 minutes", None), ("1 hour", "15 minutes"), ("50 minutes", "20 minutes")):
        stream = jobs.event_source(spark, f"{folder}/*", delay="10 seconds").withColumnRenamed("event_type", "action")
        got = {tuple(r) for r in jobs.drain(jobs.tumbling(stream, ["user_id"], width, step)).collect()}
        table = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        table = table.withColumnRenamed("event_type", "action")
        batch = {tuple(r) for r in events.windowed(table, ["user_id"], "ts", width, step).collect()}
        last = T0 + dt.timedelta(minutes=8000)
        assert got == {r for r in batch if r[1] <= last} and len(got) > 30
        w, s = (int(pd.Timedelta(x).total_seconds() // 60) for x in (width, step or width))
        want = {}
        for _, minute, user, action, value in rows:
            for start in range(minute // s * s, minute - w, -s):
                want.setdefault((start, user), []).append((action, value))
        want = {
            (T0 + dt.timedelta(minutes=start), T0 + dt.timedelta(minutes=start + w), user, len(v),
             sum(x for _, x in v if x) if any(x for _, x in v) else None, len({a for a, _ in v if a}))
            for (start, user), v in want.items()
        }
        assert got == want


def test_hot_window_of_many_actions_in_a_stream(spark):
    """A million events of one user and window, 900,000 actions apart: no state holds them as one set."""
    prepare(spark)
    folder = fresh_dir(spark, "feed")
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 250) ts"
    hot = spark.range(1_000_000, numPartitions=8)
    hot.selectExpr("id event_id", at, "7L user_id", "concat('a', id % 900000) event_type", "1.0D value", "'{}' props").write.parquet(f"{folder}/part=1")
    feed(spark, folder, [(1, 600, 7, "z", 1.0)], 2)
    stream = jobs.event_source(spark, f"{folder}/*", delay="10 seconds").withColumnRenamed("event_type", "action")
    plan = jobs.tumbling(stream, ["user_id"], "5 minutes")
    row = jobs.drain(plan).first()
    assert (row.action_count, row.total_value, row.unique_actions) == (1_000_000, 1_000_000.0, 900_000)


def test_percentiles_merge(spark):
    """Sketches of minutes merged to hours: exact while small, within their bound when large, equal in a stream."""
    prepare(spark)
    rng = random.Random(4)
    rows = [(i, rng.randrange(300), 0, rng.choice(["error", "view"]), rng.choice([rng.random(), None, float("nan")])) for i in range(900)]
    rows.append((900, 400, 0, "view", None))
    folder = fresh_dir(spark, "feed")
    feed(spark, folder, rows, 1)
    feed(spark, folder, [(9999, 9000, 1, "z", 1.0)], 2)
    table = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    wrong = F.col("event_type") == "error"
    panes = events.latency_panes(table, [], "ts", "1 minute", "value", wrong)
    streamed = jobs.drain(jobs.error_rates(jobs.event_source(spark, f"{folder}/*", delay="10 seconds"), "1 minute", wrong))
    shares = {"p50": 0.5, "p99": 0.99}

    def hours(minutes, ts):
        by = events.merged_panes(minutes.withColumn("hour", F.window(ts, "1 hour")["start"]), ["hour"])
        rows = events.with_percentiles(by, shares).where(F.col("hour") < F.lit(T0 + dt.timedelta(minutes=8000))).collect()
        return {r.hour: (r.events, r.error_rate, r.p50, r.p99) for r in rows}

    want = {}
    for _, minute, _, kind, value in rows:
        want.setdefault(T0 + dt.timedelta(hours=minute // 60), []).append((kind == "error", value))
    for hour, seen in want.items():
        values = sorted(v for _, v in seen if v is not None and v == v)
        rank = lambda share: values[math.ceil(len(values) * share) - 1] if values else None
        want[hour] = (len(seen), sum(e for e, _ in seen) / len(seen), rank(0.5), rank(0.99))
    assert hours(panes, "pane") == want
    assert hours(streamed, "window_start") == want

    big = spark.range(400_000).select(
        F.lit(T0).cast("timestamp").alias("ts"), (F.col("id") % 97).alias("part"),
        (F.pmod(F.hash("id"), F.lit(10_000_019)) / 7.0).alias("value"), F.lit(False).alias("bad"),
    )
    merged = events.merged_panes(events.latency_panes(big, ["part"], "ts", "1 minute", "value", F.col("bad")), ["pane"])
    got = events.with_percentiles(merged, {f"p{s}": s / 100 for s in (1, 25, 50, 75, 99)}).first()
    values = np.sort(big.toPandas()["value"].to_numpy())
    for share in (1, 25, 50, 75, 99):
        assert abs(np.searchsorted(values, got[f"p{share}"], "right") / len(values) - share / 100) < 0.003


def test_rollups_are_exact_at_any_size(spark, tmp_path):
    """More values an hour, and a user and phase, than a sketch keeps whole; nulls and NaN count as events only."""
    from tests.oracle import connect, differences

    rows = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 120_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 2).alias("user_id"), F.when(F.col("id") % 9 == 0, "error").otherwise("view").alias("event_type"),
        (F.pmod(F.hash("id"), F.lit(10_000_019)) / 7.0).alias("value"), F.lit("{}").alias("props"),
    )
    prepare(spark)
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    import __spark_entry__ as entry

    for name in ("latency_rollup", "gate_rollup"):
        assert differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []

    odd = spark.createDataFrame([(k, v) for k, vs in {None: [2.0, 1.0, None], 1: [float("nan"), None]}.items() for v in vs], "k int, value double")
    panes = events.value_panes(odd.withColumn("ts", F.lit(T0).cast("timestamp")), ["k"], "ts", "1 minute", "value", F.col("value") == 1.0)
    merged = events.merged_values(panes, ["k"])
    got = {r.k: (r.events, r.errors, r.p50) for r in events.value_percentiles(merged, ["k"], {"p50": 0.5}).collect()}
    assert got == {None: (3, 1, 1.0), 1: (2, 0, None)}
    sliced = events.value_percentiles(events.merged_values(events.value_panes(rows, ["user_id"], "ts", "1 day", "value", F.lit(False)), ["user_id"]), ["user_id"], {"p": 0.3}, slice_rows=5000)
    values = rows.toPandas()
    for r in sliced.collect():
        mine = np.sort(values[values.user_id == r.user_id].value.to_numpy())
        assert r.p == mine[math.ceil(len(mine) * 0.3) - 1]


def test_live_replay_calls_the_store_once_a_bucket():
    """Many episodes of a bucket cost one read, one write and one timer; done, late and abandoned ones stay apart."""
    import pandas as pd

    from episodica.streaming.replay import NAMES, ROW, LiveReplay

    class Store:
        value, timers, calls = None, set(), 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

        def registerTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.remove(at)

    class Times:
        mark = 0
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.mark  # noqa: E731, N815

    store, times, live = Store(), Times(), LiveReplay(1000)
    live.init(store)

    def run(rows):
        before = store.calls
        out = [r for part in live.handleInputRows((0,), iter([pd.DataFrame(rows, columns=ROW)]), times) for r in part[NAMES].itertuples(index=False)]
        assert store.calls - before <= 4 and len(store.timers) == 1
        return {(r.episode_id, r.steps, tuple(r.loaded), r.status) for r in out}

    def ring():
        (at,) = store.timers
        store.timers.clear()
        times.mark = max(times.mark, at)
        return {(r.episode_id, r.steps, tuple(r.loaded), r.status) for part in live.handleExpiredTimer((0,), times, times) for r in part.itertuples()}

    # In order of time, whatever the order of rows; a load beyond the budget is turned away.
    rows = [(f"e{i}", "t", 1, 5_000_000 - k * 1000, k, act) for i in range(200) for k, act in enumerate(["+b", "+a"])]
    assert run(rows) == set() and store.timers == {6000}
    assert run([("e7", "t", 1, 5_500_000, 3, "!true"), ("e7", "t", 1, 5_600_000, 4, "+c"), ("e0", "t", 1, 4_000_000, 5, "")]) == {("e7", 3, ("a",), "done")}
    assert run([("e7", "t", 1, 5_700_000, 6, "+c"), ("e7", "t", 1, 5_700_000, 7, "+c")]) == {("e7", 2, (), "late")}
    assert run([("old", "t", 1, 4_500_000, 8, "-a")]) == set() and store.timers == {5500}
    assert ring() == {("old", 1, (), "abandoned")} and store.timers == {6000}
    assert ring() == {(f"e{i}", 3 if i == 0 else 2, ("a",), "abandoned") for i in range(200) if i != 7}
    assert run([("e1", "t", 1, 6_100_000, 9, "+a")]) == {("e1", 1, (), "late")}
    while store.timers:
        assert ring() == set()
    assert store.value is None
