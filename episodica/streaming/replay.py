"""Live replay: one row per episode, emitted at its submit or when it is abandoned; rows for what comes later."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from episodica.functions.episode import LOAD, UNLOAD, advance
from episodica.operators.replay import IDS, normalise
from episodica.plans.skew import keyed_join

# What is kept of the episodes of a bucket; due_ms is when one counts as idle, timer_ms when the bucket's timer rings.
EPISODE = f"episode_id: string, task_id: string, budget: int, loaded: {IDS}, ever: {IDS}, steps: long, status: string, due_ms: long"
STATE = f"episodes array<struct<{EPISODE}>>, timer_ms long"
BUCKETS = 16_384  # a call of the store costs as much for a bucket as for an episode
OUTPUT = (
    f"episode_id string, task_id string, steps long, loaded {IDS}, ever {IDS}, "
    "done boolean, correct boolean, status string"
)
# State is kept in the store on disk, with timers per key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
# An action is one short text: the sign and the skill, or ! and the result for a submit.
ROW = ["episode_id", "task_id", "budget", "micros", "event_id", "act"]
OPS = {"+": LOAD, "-": UNLOAD}


class LiveReplay(StatefulProcessor):
    """The state of the episodes of one bucket, and a timer for the earliest time at which one counts as idle.

    A timer is not moved with every action: one that rings before an episode is due is set
    anew for the next due time. A batch costs one read and one write of the state of a bucket
    that it meets, however many of its episodes have actions.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, int | None]:
        """Episodes by key as (loaded, ever, steps, status, due), and the time of the timer."""
        kept = self.state.get()
        if not kept:
            return {}, None
        return {tuple(e[:3]): (list(e[3]), list(e[4]), *e[5:]) for e in map(tuple, kept[0])}, kept[1]

    def _keep(self, episodes: dict, timer: int | None) -> None:
        if not episodes:
            self.state.clear()
            return
        due = min(e[4] for e in episodes.values())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update(([(*key, *e) for key, e in episodes.items()], timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        episodes, timer = self._read()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        actions = sorted(action for part in rows for action in zip(*(part[c] for c in ROW)))
        for episode, mine in groupby(actions, key=lambda action: action[:3]):
            kept = episodes.get(episode)
            loaded, ever, steps, status, _ = kept or ([], [], 0, "open", 0)
            mine, correct, closed = list(mine), None, status != "open"
            if not closed:
                for *_, act in mine:
                    steps += 1
                    if act.startswith("!"):
                        status, correct = "done", act == "!true"
                        break
                    if act:
                        advance(loaded, ever, episode[2], OPS[act[0]], act[1:])
            due = max(mine[-1][3] // 1000, mark) + self.idle_ms
            due = max(due, kept[4]) if kept else due
            episodes[episode] = (*((loaded, ever) if status == "open" else ([], [])), steps, status, due)
            if closed:
                out.append(self._row(episode, len(mine), [], [], None, "late"))
            elif status == "done":
                out.append(self._row(episode, steps, loaded, ever, correct, "done"))
        self._keep(episodes, timer)
        yield from self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        episodes, _ = self._read()
        mark, left, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), {}, []
        for episode, (loaded, ever, steps, status, due) in episodes.items():
            if due > mark:
                left[episode] = (loaded, ever, steps, status, due)
            elif status == "open":
                # A closed marker stays as long again, so that late actions open no new episode.
                left[episode] = ([], [], steps, "abandoned", mark + self.idle_ms)
                out.append(self._row(episode, steps, loaded, ever, None, "abandoned"))
        self._keep(left, None)
        yield from self._table(out)

    @staticmethod
    def _row(key, steps: int, loaded: list, ever: list, correct: bool | None, status: str) -> tuple:
        return (key[0], key[1], steps, loaded, ever, status == "done", correct, status)

    @staticmethod
    def _table(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=NAMES)


def stream_replay(actions: DataFrame, setting: DataFrame, idle_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """Replay a watermarked stream of actions, in order of (ts, event_id) per micro-batch.

    ``status`` of an output row: ``done`` at the submit; ``abandoned`` once the episode has
    been idle for ``idle_seconds`` of event time without one; ``late`` for a batch of
    actions that came after either, with their number as ``steps``: they change nothing.
    Choose ``idle_seconds`` above the longest pause of an episode. A closed episode leaves
    a small marker, which goes after the same time. The state of an open one is its two
    lists, so it stays as small as a catalog. Episodes share the state of one of ``buckets``, by
    hash of their id; take more where far more than a hundred episodes a bucket are open at a time, as a
    batch reads and writes the whole of each bucket that it meets.
    """
    rows = keyed_join(actions, setting, ["episode_id"])
    kind, skill = normalise(F.col("action_type")), F.col("skill_id")
    given = skill.isNotNull() & (skill != "")
    act = (
        F.when(kind == "submit", F.concat(F.lit("!"), F.coalesce("correct", F.lit(False)).cast("string")))
        .when(given & (kind == "load") & F.array_contains("catalog", skill), F.concat(F.lit("+"), skill))
        .when(given & (kind == "unload"), F.concat(F.lit("-"), skill))
        .otherwise("")
    )
    number = F.col("event_id")
    if isinstance(rows.schema["event_id"].dataType, IntegralType):
        number = F.coalesce(number.cast("long"), F.lit(-(1 << 63)))  # no null in it, which would make it a float
    bucket = F.pmod(F.xxhash64("episode_id"), F.lit(buckets)).cast("int")
    rows = rows.select(
        bucket.alias("bucket"), "episode_id", "task_id", "budget", "ts", F.unix_micros("ts").alias("micros"), number.alias("event_id"), act.alias("act")
    )
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("bucket").transformWithStateInPandas(
        LiveReplay(idle_seconds * 1000), OUTPUT, "Append", "EventTime"
    )
