"""Replay of logged actions under a context budget.

``stage`` classifies actions and numbers them, ``replay_state`` gives one row per
episode, ``replay_steps`` one row per action. Ordinary episodes are folded natively;
episodes above ``FOLD_ROWS`` run as ordered Arrow streams; episodes above the slice size are cut
into slices whose effect on every possible start state is worked out in parallel, so
no task ever holds one whole giant episode.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.episode import LOAD, UNLOAD, advance
from episodica.plans.skew import HOT_ROWS, SLICE, keyed_join, ordered, slice_keys
from episodica.session import durable

FOLD_ROWS = 2_000
START_STATES = 4_096
IDS = "array<string>"


def normalise(action_type: Column) -> Column:
    """``invoke`` is ``load``; anything but the three known types is ``unknown``."""
    return (
        F.when(action_type == "invoke", "load")
        .when(action_type.isin("load", "unload", "submit"), action_type)
        .otherwise("unknown")
    )


def settings(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per episode: its task, catalog ids and budget."""
    picked = tasks.select("task_id", F.concat("relevant", "distractors").alias("catalog"))
    return keyed_join(episodes, picked, ["task_id"]).withColumn(
        "budget", F.coalesce("context_budget", F.lit(5))
    ).drop("context_budget")


def rejected(actions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Actions of episodes that were never started; ``stage`` leaves them out."""
    return keyed_join(actions, episodes.select("episode_id").distinct(), ["episode_id"], "left_anti")


def restarted(episodes: DataFrame) -> DataFrame:
    """Episode ids that were started more than once; a new episode needs a new id."""
    starts = episodes.groupBy("episode_id").agg(F.count(F.lit(1)).alias("starts"))
    return starts.where(F.col("starts") > 1)


class Staged:
    """Classified, numbered actions, still partitioned by episode (and slice).

    The id lists stay behind in ``setting``; they do not travel with every action.
    """

    def __init__(self, rows: DataFrame, setting: DataFrame, largest: int, split: bool):
        self.rows, self.setting, self.largest, self.split = rows, setting, largest, split


def stage(
    actions: DataFrame,
    setting: DataFrame,
    order: list[str],
    skills: DataFrame | None = None,
    slice_rows: int = HOT_ROWS,
) -> Staged:
    """Classify each action as far as that needs no state, and number the steps.

    ``code`` is final where set; null marks loads and unloads that depend on the state.
    """
    rows = keyed_join(actions, setting, ["episode_id"])
    if skills is not None:
        known = skills.select("skill_id", F.lit(True).alias("_known"))
        rows = keyed_join(rows, known, ["skill_id"], "left")
    else:
        rows = rows.withColumn("_known", F.lit(True))
    kind, skill = F.col("kind"), F.col("skill_id")
    missing = skill.isNull() | (skill == "")
    rows = rows.withColumn("kind", normalise(F.col("action_type"))).withColumn(
        "code",
        F.when(kind == "unknown", "unknown_type")
        .when(kind == "submit", "submitted")
        .when(missing, "missing_id")
        .when((kind == "load") & F.col("_known").isNull(), "unknown_skill")
        .when((kind == "load") & ~F.array_contains("catalog", skill), "not_in_catalog"),
    )
    sliced = slice_keys(rows.drop("_known", "catalog"), ["episode_id"], order, slice_rows, actions, need_largest=True)
    submit = F.when(kind == "submit", 1).otherwise(0)
    rows = ordered(
        sliced, ["episode_id"], order, number="step", running={"_submits": submit}, keep_slice=True
    )
    after = F.col("_submits") > submit
    rows = rows.withColumn("code", F.when(after, "after_done").otherwise(F.col("code")))
    op = F.when(F.col("code").isNotNull(), 0).when(kind == "load", LOAD).otherwise(UNLOAD)
    return Staged(rows.withColumn("op", op).drop("_submits"), setting, sliced.largest, sliced.split)


# --- native folds -------------------------------------------------------------------


def _takes(state: Column, act: Column, budget: Column) -> Column:
    held = F.array_contains(state["loaded"], act["skill_id"])
    return (act["op"] == LOAD) & ~held & (F.size(state["loaded"]) < budget)


def _next_loaded(state: Column, act: Column, budget: Column) -> Column:
    return (
        F.when(_takes(state, act, budget), F.array_append(state["loaded"], act["skill_id"]))
        .when(act["op"] == UNLOAD, F.array_remove(state["loaded"], act["skill_id"]))
        .otherwise(state["loaded"])
    )


def _next_ever(state: Column, act: Column, budget: Column) -> Column:
    new = _takes(state, act, budget) & ~F.array_contains(state["ever"], act["skill_id"])
    return F.when(new, F.array_append(state["ever"], act["skill_id"])).otherwise(state["ever"])


def _outcome(state: Column, act: Column, budget: Column) -> Column:
    held = F.array_contains(state["loaded"], act["skill_id"])
    return (
        F.when(act["op"] == 0, act["code"])
        .when(act["op"] == UNLOAD, F.when(held, "unloaded").otherwise("not_loaded"))
        .when(held, "already_loaded")
        .when(F.size(state["loaded"]) >= budget, "budget_full")
        .otherwise("loaded")
    )


def _empty() -> list[Column]:
    return [F.array().cast(IDS).alias("loaded"), F.array().cast(IDS).alias("ever")]


def _native_state(rows: DataFrame) -> DataFrame:
    acts = F.when(F.col("op") != 0, F.struct("step", "op", "skill_id"))
    folded = F.aggregate(
        F.array_sort("acts"),
        F.struct(*_empty()),
        lambda s, a: F.struct(
            _next_loaded(s, a, F.col("budget")).alias("loaded"),
            _next_ever(s, a, F.col("budget")).alias("ever"),
        ),
    )
    return (
        rows.groupBy("episode_id")
        .agg(*_summary(), F.collect_list(acts).alias("acts"))
        .withColumn("state", folded)
        .select("episode_id", *SUMMARY, "state.loaded", "state.ever")
    )


SUMMARY = ["task_id", "budget", "steps", "done", "correct"]


def _summary() -> list[Column]:
    submitted = F.col("code") == "submitted"
    return [
        *[F.first(c).alias(c) for c in ("task_id", "budget")],
        F.count(F.lit(1)).alias("steps"),
        F.coalesce(F.bool_or(submitted), F.lit(False)).alias("done"),
        F.bool_or(F.when(submitted, F.coalesce("correct", F.lit(False)))).alias("correct"),
    ]


def _native_steps(rows: DataFrame) -> DataFrame:
    start = F.array(
        F.struct(
            F.lit(0).cast("long").alias("step"),
            *[F.lit(None).cast("string").alias(c) for c in ("outcome", "action_type", "skill_id")],
            F.lit(None).cast("boolean").alias("correct"),
            *_empty(),
        )
    )

    def follow(done: Column, act: Column) -> Column:
        state = F.element_at(done, -1)
        budget = F.col("budget")
        return F.array_append(
            done,
            F.struct(
                act["step"].alias("step"),
                _outcome(state, act, budget).alias("outcome"),
                act["action_type"].alias("action_type"),
                act["skill_id"].alias("skill_id"),
                act["correct"].alias("correct"),
                _next_loaded(state, act, budget).alias("loaded"),
                _next_ever(state, act, budget).alias("ever"),
            ),
        )

    acts = F.array_sort(F.collect_list(F.struct("step", "op", "code", "action_type", "skill_id", "correct")))
    return (
        rows.groupBy("episode_id")
        .agg(F.first("task_id").alias("task_id"), F.first("budget").alias("budget"), acts.alias("acts"))
        .select("episode_id", "task_id", "budget", F.aggregate("acts", start, follow).alias("log"))
        .select("episode_id", "task_id", "budget", F.inline(F.slice("log", 2, F.size("log"))))
    )


# --- Arrow folds for long episodes and slices ---------------------------------------

STEP_SCHEMA = (
    "episode_id string, task_id string, budget int, step long, outcome string, "
    f"action_type string, skill_id string, correct boolean, loaded {IDS}, ever {IDS}"
)


STEP_NAMES = [part.split()[0] for part in STEP_SCHEMA.replace(f"loaded {IDS}, ever {IDS}", "loaded x, ever x").split(", ")]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps of whole (episode, slice) runs that come in order; a run may span batches."""
    run, loaded, ever = None, [], []
    for pdf in batches:
        outcomes, held, seen = [], [], []
        columns = ("episode_id", SLICE, "op", "code", "skill_id", "budget", "loaded0", "ever0")
        for episode, piece, op, code, skill, budget, loaded0, ever0 in zip(*[pdf[c] for c in columns]):
            if run != (episode, piece):
                run, loaded, ever = (episode, piece), list(loaded0), list(ever0)
            outcomes.append(advance(loaded, ever, budget, op, skill) if op else code)
            held.append(tuple(loaded))
            seen.append(tuple(ever))
        yield pdf.assign(outcome=outcomes, loaded=held, ever=seen)[STEP_NAMES]


def _walked(rows: DataFrame) -> DataFrame:
    runs = rows.repartition("episode_id", SLICE).sortWithinPartitions("episode_id", SLICE, "step")
    need = ["task_id", "step", "action_type", "correct", "episode_id", SLICE, "op", "code", "skill_id", "budget", "loaded0", "ever0"]
    return runs.select(*need).mapInPandas(_walk, STEP_SCHEMA)


def _end_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    loaded, ever = list(first["loaded0"]), list(first["ever0"])
    acts = pdf[pdf["op"] != 0].sort_values("step")
    for op, skill in zip(acts["op"], acts["skill_id"]):
        advance(loaded, ever, int(first["budget"]), op, skill)
    return pd.DataFrame(
        {"episode_id": [first["episode_id"]], SLICE: [first[SLICE]], "loaded": [loaded], "ever": [ever]}
    )


END_SCHEMA = f"episode_id string, {SLICE} int, loaded {IDS}, ever {IDS}"


def _from_empty(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"loaded0": F.array().cast(IDS), "ever0": F.array().cast(IDS)})


# --- slices of giant episodes -------------------------------------------------------


def slice_effect(steps, ops, bits, starts: np.ndarray, n_bits: int, budget: int):
    """End mask per start mask, with the last and first step each skill was taken in."""
    masks = starts.copy()
    used = np.array([int(m).bit_count() for m in masks])
    last = np.zeros((len(masks), n_bits), dtype=np.int64)
    first = np.zeros_like(last)
    for step, op, bit in zip(steps, ops, bits):
        flag = np.int64(1) << np.int64(bit)
        held = (masks & flag) != 0
        if op == UNLOAD:
            masks[held] &= ~flag
            used[held] -= 1
        else:
            takes = ~held & (used < budget)
            masks[takes] |= flag
            used[takes] += 1
            last[takes, bit] = step
            new = takes & (first[:, bit] == 0)
            first[new, bit] = step
    return masks, last, first


def _start_masks(n_bits: int, budget: int) -> np.ndarray:
    sets = (c for k in range(min(n_bits, budget) + 1) for c in combinations(range(n_bits), k))
    return np.array([sum(1 << b for b in c) for c in sets], dtype=np.int64)


EFFECT_SCHEMA = (
    f"episode_id string, {SLICE} int, catalog {IDS}, budget int, "
    "ends array<long>, last array<long>, first array<long>"
)


def _effect_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    head = pdf.iloc[0]
    catalog, budget = list(head["catalog"]), int(head["budget"])
    acts = pdf[(pdf["op"] != 0) & pdf["skill_id"].isin(catalog)].sort_values("step")
    position = {skill: i for i, skill in enumerate(catalog)}
    starts = _start_masks(len(catalog), budget)
    ends, last, first = slice_effect(
        acts["step"], acts["op"], acts["skill_id"].map(position), starts, len(catalog), budget
    )
    return pd.DataFrame(
        {
            "episode_id": [head["episode_id"]],
            SLICE: [head[SLICE]],
            "catalog": [catalog],
            "budget": [budget],
            "ends": [ends],
            "last": [last.ravel()],
            "first": [first.ravel()],
        }
    )


CHAIN_SCHEMA = f"episode_id string, {SLICE} int, loaded0 {IDS}, ever0 {IDS}, loaded {IDS}, ever {IDS}"


def _chain_of_episode(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow the slice effects of one episode from the empty state."""
    pdf = pdf.sort_values(SLICE)
    catalog, budget = list(pdf["catalog"].iat[0]), int(pdf["budget"].iat[0])
    width = len(catalog)
    row_of = {int(m): i for i, m in enumerate(_start_masks(width, budget))}
    mask, taken, seen = 0, {}, {}
    states = [([], [])]
    for ends, last, first in zip(pdf["ends"], pdf["last"], pdf["first"]):
        at = row_of[mask]
        for bit in range(width):
            if last[at * width + bit]:
                taken[bit] = last[at * width + bit]
                seen.setdefault(bit, first[at * width + bit])
        mask = int(ends[at])
        held = sorted((b for b in range(width) if mask >> b & 1), key=taken.get)
        states.append(([catalog[b] for b in held], [catalog[b] for b in sorted(seen, key=seen.get)]))
    return pd.DataFrame(
        {
            "episode_id": pdf["episode_id"].to_numpy(),
            SLICE: pdf[SLICE].to_numpy(),
            "loaded0": [s[0] for s in states[:-1]],
            "ever0": [s[1] for s in states[:-1]],
            "loaded": [s[0] for s in states[1:]],
            "ever": [s[1] for s in states[1:]],
        }
    )


# --- speculation, for catalogs too wide to list every start state ---------------------

RUN_SCHEMA = f"episode_id string, {SLICE} int, start {IDS}, kept {IDS}, added {IDS}, taken {IDS}"
FOLLOW_SCHEMA = f"episode_id string, {SLICE} int, start {IDS}, known boolean, loaded0 {IDS}, ever0 {IDS}, loaded {IDS}, ever {IDS}"
RUN = ["start", "kept", "added", "taken"]


def _run_of_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one slice does to one start set.

    ``kept``: ids of the start that were never unloaded. ``added``: ids it loaded and still holds at its end,
    in order of their last load. ``taken``: ids it loaded, in order of their first load.
    """
    head = pdf.iloc[0]
    start, budget = list(head["start"]), int(head["budget"])
    held, kept, added, taken = set(start), set(start), {}, {}
    acts = pdf[pdf["op"].notna()].sort_values("step")
    for op, skill in zip(acts["op"], acts["skill_id"]):
        if op == UNLOAD:
            held.discard(skill)
            kept.discard(skill)
            added.pop(skill, None)
        elif skill not in held and len(held) < budget:
            held.add(skill)
            added[skill] = None
            taken.setdefault(skill)
    return pd.DataFrame(
        {
            "episode_id": [head["episode_id"]], SLICE: [head[SLICE]], "start": [start],
            "kept": [sorted(kept)], "added": [list(added)], "taken": [list(taken)],
        }
    )


def _likely_end(start: set, runs: list, touched: dict, pending: dict, budget: int) -> list:
    """A guess of the end state for a start that was not run.

    From the run whose start is most alike, plus the ids it did not start with and that the slice never
    unloads. Without any run: of the ids whose last action is a load, those that wait longest. That is the true
    state as long as the budget turned no load away.
    """
    if not runs:
        return sorted(pending, key=lambda skill: (pending[skill], skill))[:budget]
    near = max(runs, key=lambda run: (len(start & set(run["start"])) - len(start ^ set(run["start"])), list(run["start"])))
    others = [s for s in sorted(start - set(near["start"])) if touched.get(s, (None,))[0] is None]
    ends = [s for s in near["kept"] if s in start] + others
    return list(dict.fromkeys(ends + list(near["added"])))[:budget]


def _follow_episode(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hand the state over from slice to slice, by runs where there are any and by guesses elsewhere.

    The lists are given as far as every start so far was run, so they are exact; beyond that they are null.
    """
    pdf = pdf.sort_values(SLICE)
    loaded, ever, exact, guess, pending, out = [], [], True, [], {}, []
    for episode, piece, budget, hints, runs in zip(*[pdf[c] for c in ("episode_id", SLICE, "budget", "hints", "runs")]):
        hints = {} if hints is None else {h["skill_id"]: (h["unloaded"], h["first"], h["last"]) for h in hints}
        runs = [] if runs is None else list(runs)
        start = sorted(loaded if exact else guess)
        run = next((r for r in runs if list(r["start"]) == start), None)
        before = (list(loaded), list(ever)) if exact else (None, None)
        for skill, (unloaded, first, last) in hints.items():
            if unloaded is not None:
                pending.pop(skill, None)
            if last is not None and (unloaded is None or last > unloaded):
                pending.setdefault(skill, first if unloaded is None else last)
        if run is None:
            guess = _likely_end(set(start), runs, hints, pending, int(budget))
            exact = False
        else:
            guess = [*run["kept"], *run["added"]]
        if exact:
            loaded = [s for s in loaded if s in set(run["kept"])] + list(run["added"])
            ever = list(dict.fromkeys([*ever, *run["taken"]]))
        after = (list(loaded), list(ever)) if exact else (None, None)
        out.append((episode, piece, start, run is not None, *before, *after))
    names = ["episode_id", SLICE, "start", "known", "loaded0", "ever0", "loaded", "ever"]
    return pd.DataFrame(out, columns=names)


def speculate(giant: DataFrame, setting: DataFrame) -> tuple[DataFrame, int]:
    """State at the start and end of every slice, and the number of rounds it took.

    In a round all slices whose start was not run yet run side by side, each from a guess; the hand-overs are then
    compared, and what started wrong goes to the next round. The first such slice has its true start,
    so a round settles one slice at least; runs are kept, none is done twice. One round does where the budget
    turns no load away, and a few where slices are long enough to forget their start; there are never more than
    slices. Of an episode only its slices, with lists no longer than the catalog, come together in one task.
    """
    key = ["episode_id", SLICE]
    acts = keyed_join(giant, setting.select("episode_id", "catalog"), ["episode_id"])
    acts = acts.where((F.col("op") != 0) & F.array_contains("catalog", F.col("skill_id")))
    acts = durable(acts.select(*key, "step", "op", "skill_id"))
    slices = giant.groupBy(*key).agg(F.first("budget").alias("budget"))
    load = F.when(F.col("op") == LOAD, F.col("step"))
    hints = acts.groupBy(*key, "skill_id").agg(
        F.max(F.when(F.col("op") == UNLOAD, F.col("step"))).alias("unloaded"),
        F.min(load).alias("first"), F.max(load).alias("last"),
    )
    hints = hints.groupBy(*key).agg(F.collect_list(F.struct("skill_id", "unloaded", "first", "last")).alias("hints"))
    slices = durable(slices.join(hints, key, "left"))
    runs, rounds = None, 0
    while True:
        told = slices.withColumn("runs", F.lit(None).cast(f"array<struct<{', '.join(f'{n}: {IDS}' for n in RUN)}>>"))
        if runs is not None:
            told = slices.join(runs.groupBy(*key).agg(F.collect_list(F.struct(*RUN)).alias("runs")), key, "left")
        chain = durable(told.groupBy("episode_id").applyInPandas(_follow_episode, FOLLOW_SCHEMA))
        todo = chain.where(~F.col("known")).select(*key, "start")
        if todo.isEmpty():
            return chain.drop("start", "known"), rounds
        rounds += 1
        now = todo.join(slices.select(*key, "budget"), key).join(acts, key, "left")
        done = durable(now.groupBy(*key).applyInPandas(_run_of_slice, RUN_SCHEMA))
        runs = done if runs is None else runs.unionByName(done)


def slice_chain(giant: DataFrame, setting: DataFrame) -> DataFrame:
    """State at the start and end of every slice of the giant episodes."""
    giant = giant.select("episode_id", SLICE, "step", "op", "skill_id", "budget")
    listed = keyed_join(giant, setting.select("episode_id", "catalog"), ["episode_id"])
    width, budget = listed.agg(F.max(F.size("catalog")), F.max("budget")).first()
    states = sum(comb(width, k) for k in range(min(width, budget) + 1))
    if states > START_STATES or width > 62:
        return speculate(giant, setting)[0]
    effects = listed.groupBy("episode_id", SLICE).applyInPandas(_effect_of_group, EFFECT_SCHEMA)
    return durable(effects.groupBy("episode_id").applyInPandas(_chain_of_episode, CHAIN_SCHEMA))


# --- operators ----------------------------------------------------------------------


def _by_size(staged: Staged, fold_rows: int):
    """Short episodes, long ones, and slices of giant ones (None where there are none)."""
    if staged.largest <= fold_rows:
        return staged.rows, None, None
    size = F.count(F.lit(1)).over(Window.partitionBy("episode_id", SLICE))
    rows = staged.rows.withColumn("_size", size)
    short = rows.where((F.col(SLICE) == 0) & (F.col("_size") <= fold_rows)).drop("_size") if fold_rows else None
    long = rows.where((F.col(SLICE) == 0) & (F.col("_size") > fold_rows)).drop("_size")
    giant = rows.where(F.col(SLICE) > 0).drop("_size") if staged.split else None
    return short, long, giant


def replay_state(staged: Staged, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """One row per episode: state after its last action, and whether it was submitted."""
    short, long, giant = _by_size(staged, fold_rows)
    parts = [] if short is None else [_native_state(short)]
    if long is not None:
        ends = _from_empty(long).groupBy("episode_id", SLICE).applyInPandas(_end_of_group, END_SCHEMA)
        parts.append(_with_summary(long, ends))
    if giant is not None:
        chain = slice_chain(giant, staged.setting)
        final = chain.groupBy("episode_id").agg(F.max_by(F.struct("loaded", "ever"), SLICE).alias("s"))
        parts.append(_with_summary(giant, final.select("episode_id", "s.*")))
    used = F.size("loaded")
    return reduce(DataFrame.unionByName, parts).withColumns({"used": used, "remaining": F.col("budget") - used})


def _with_summary(rows: DataFrame, ends: DataFrame) -> DataFrame:
    totals = rows.groupBy("episode_id").agg(*_summary())
    return totals.join(ends.select("episode_id", "loaded", "ever"), "episode_id")


def replay_steps(staged: Staged, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """One row per action: outcome, and both lists after it."""
    short, long, giant = _by_size(staged, fold_rows)
    parts = [] if short is None else [_native_steps(short)]
    if long is not None:
        parts.append(replay_pandas(long))
    if giant is not None:
        chain = slice_chain(giant, staged.setting).select("episode_id", SLICE, "loaded0", "ever0")
        started = giant.join(chain, ["episode_id", SLICE])
        parts.append(_walked(started))
    return reduce(DataFrame.unionByName, parts).withColumn("used", F.size("loaded"))


def replay_pandas(rows: DataFrame) -> DataFrame:
    """The same steps from an ordered Arrow stream, for episodes of thousands of actions."""
    return _walked(_from_empty(rows))
