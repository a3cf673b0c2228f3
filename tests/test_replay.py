"""Replay and reward against golden rows, and all replay paths against each other."""

import pytest
from pyspark.sql import functions as F

from episodica.operators import render, replay, reward
from episodica.plans import episode_queries
from episodica.session import prepare

SMALL = "/root/testdata/sf0.001"
ACTIONS = [
    ("load", "a"), ("load", "a"), ("invoke", "b"), ("load", "zz"), ("load", "c"), ("load", "d"),
    ("unload", "a"), ("unload", "a"), ("load", "d"), ("load", ""), ("dance", None), ("submit", None), ("load", "a"),
]
EXPECTED = [
    ("loaded", "a", "a"), ("already_loaded", "a", "a"), ("loaded", "ab", "ab"), ("not_in_catalog", "ab", "ab"),
    ("loaded", "abc", "abc"), ("budget_full", "abc", "abc"), ("unloaded", "bc", "abc"), ("not_loaded", "bc", "abc"),
    ("loaded", "bcd", "abcd"), ("missing_id", "bcd", "abcd"), ("unknown_type", "bcd", "abcd"),
    ("submitted", "bcd", "abcd"), ("after_done", "bcd", "abcd"),
]


def golden(spark):
    rows = [("e1", i, kind, skill, kind == "submit" or None) for i, (kind, skill) in enumerate(ACTIONS)]
    actions = spark.createDataFrame(rows, "episode_id string, at int, action_type string, skill_id string, correct boolean")
    episodes = spark.createDataFrame([("e1", "t1", 3)], "episode_id string, task_id string, context_budget int")
    tasks = spark.createDataFrame(
        [("t1", ["a", "b"], ["c", "d", "e", "f"])], "task_id string, relevant array<string>, distractors array<string>"
    )
    return actions, replay.settings(episodes, tasks)


@pytest.mark.parametrize("sizes", [{}, {"fold_rows": 0}, {"slice_rows": 4}, {"slice_rows": 2, "fold_rows": 1}])
def test_golden_steps(spark, sizes):
    actions, setting = golden(prepare(spark))
    staged = replay.stage(actions, setting, ["at"], slice_rows=sizes.get("slice_rows", 1_000_000))
    assert staged.split == ("slice_rows" in sizes)
    steps = replay.replay_steps(staged, sizes.get("fold_rows", replay.FOLD_ROWS)).orderBy("step").collect()
    assert [r.step for r in steps] == list(range(1, 14))
    assert [(r.outcome, "".join(r.loaded), "".join(r.ever)) for r in steps] == EXPECTED
    state = replay.replay_state(staged, sizes.get("fold_rows", replay.FOLD_ROWS)).first()
    assert (state.steps, state.done, state.correct, state.used, state.remaining) == (13, True, True, 3, 0)
    assert state.loaded == list("bcd") and state.ever == list("abcd")


def test_unknown_skill_comes_before_catalog(spark):
    actions, setting = golden(prepare(spark))
    known = spark.createDataFrame([(c,) for c in "abcdef"], "skill_id string")
    steps = replay.replay_steps(replay.stage(actions, setting, ["at"], known))
    assert steps.where("step = 4").first().outcome == "unknown_skill"


def test_random_episodes_against_a_plain_loop(spark):
    """600 random episodes over a wide catalog, folded natively and by a plain loop."""
    import random

    prepare(spark)
    rng = random.Random(5)
    ids = [f"x{i}" for i in range(12)]
    rows, want = [], {}
    for number in range(600):
        budget, loaded, ever = number % 6, [], []
        for at in range(rng.randrange(1, 40)):
            kind, skill = rng.choice(["load", "invoke", "unload", "noop"]), rng.choice(ids)
            rows.append((f"e{number}", at, kind, skill, None))
            if kind in ("load", "invoke") and skill in ids[:10] and skill not in loaded and len(loaded) < budget:
                loaded.append(skill)
                ever += [skill] if skill not in ever else []
            elif kind == "unload" and skill in loaded:
                loaded.remove(skill)
        want[f"e{number}"] = (loaded, ever)
    actions = spark.createDataFrame(rows, "episode_id string, at int, action_type string, skill_id string, correct boolean")
    episodes = spark.createDataFrame([(f"e{n}", "t", n % 6) for n in range(600)], "episode_id string, task_id string, context_budget int")
    tasks = spark.createDataFrame([("t", ids[:2], ids[2:10])], "task_id string, relevant array<string>, distractors array<string>")
    staged = replay.stage(actions, replay.settings(episodes, tasks), ["at"])
    assert {r.episode_id: (r.loaded, r.ever) for r in replay.replay_state(staged).collect()} == want
    last = replay.replay_steps(staged).groupBy("episode_id").agg(F.max_by(F.struct("loaded", "ever"), "step").alias("s"))
    assert {r.episode_id: (r.s.loaded, r.s.ever) for r in last.collect()} == want


def _bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_all_paths_agree(spark, monkeypatch):
    """Native fold, ordered stream, slices with effect tables, slices by speculation."""
    prepare(spark)
    plain = episode_queries.staged(spark, SMALL)
    steps, states = _bag(replay.replay_steps(plain)), _bag(replay.replay_state(plain))
    assert _bag(replay.replay_steps(plain, fold_rows=5)) == steps
    assert _bag(replay.replay_state(plain, fold_rows=5)) == states
    sliced = episode_queries.staged(spark, SMALL, slice_rows=7)
    assert sliced.split
    assert _bag(replay.replay_steps(sliced, fold_rows=4)) == steps
    assert _bag(replay.replay_state(sliced, fold_rows=4)) == states
    monkeypatch.setattr(replay, "START_STATES", 1)
    assert _bag(replay.replay_steps(sliced, fold_rows=4)) == steps


def _giants(spark, seed, budget, unload, used, size, width=200):
    """Three long episodes over a wide catalog, and their states after every step by a plain loop."""
    import random

    rng, rows, want = random.Random(seed), [], {}
    ids = [f"x{i:03d}" for i in range(width)]
    for name in ("e0", "e1", "e2"):
        loaded, ever = [], []
        for at in range(size):
            kind = "unload" if rng.random() < unload else rng.choice(["load", "load", "invoke", "noop"])
            skill = rng.choice([*ids[:used], "stranger", ""])
            rows.append((name, at, kind, skill, None))
            if kind in ("load", "invoke") and skill in ids and skill not in loaded and len(loaded) < budget:
                loaded.append(skill)
                ever += [skill] if skill not in ever else []
            elif kind == "unload" and skill in loaded:
                loaded.remove(skill)
            want[name, at + 1] = (tuple(loaded), tuple(ever))
    actions = spark.createDataFrame(rows, "episode_id string, at int, action_type string, skill_id string, correct boolean")
    episodes = spark.createDataFrame([(f"e{n}", "t", budget) for n in range(3)], "episode_id string, task_id string, context_budget int")
    tasks = spark.createDataFrame([("t", ids[:9], ids[9:])], "task_id string, relevant array<string>, distractors array<string>")
    return actions, replay.settings(episodes, tasks), want


# budget, share of unloads, ids in use, actions, rows a slice, rounds allowed
SPECULATED = [
    (1000, 0.4, 100, 1000, 45, 1),  # the budget turns nothing away
    (8, 0.5, 12, 1500, 150, 4),  # slices long enough to forget their start
    (8, 0.3, 100, 300, 45, 7),  # no slice forgets it: rounds are bounded by the slices only
    (0, 0.3, 20, 200, 45, 1),
]


@pytest.mark.parametrize("budget, unload, used, size, slice_rows, most", SPECULATED)
def test_speculation_over_a_wide_catalog(spark, budget, unload, used, size, slice_rows, most):
    """Equal to a plain loop; one round where no load is turned away, few where slices forget their start."""
    prepare(spark)
    actions, setting, want = _giants(spark, budget, budget, unload, used, size)
    staged = replay.stage(actions, setting, ["at"], slice_rows=slice_rows)
    chain, rounds = replay.speculate(staged.rows.where("_slice > 0"), setting)
    assert chain.count() >= 3 * size / slice_rows / 2 and rounds <= most
    steps = replay.replay_steps(staged, fold_rows=4).collect()
    assert {(r.episode_id, r.step): (tuple(r.loaded), tuple(r.ever)) for r in steps} == want
    state = {r.episode_id: (tuple(r.loaded), tuple(r.ever)) for r in replay.replay_state(staged, fold_rows=4).collect()}
    assert state == {e: want[e, size] for e in ("e0", "e1", "e2")}


# correct, loaded, relevant, ever loaded, reward
REWARDS = [
    (True, "A", "A", "A", 1.0), (True, "AB", "A", "AB", 0.65), (True, "A", "A", "BA", 0.95),
    (True, "", "A", "", 0.6), (False, "A", "A", "A", 0.4), (False, "", "A", "", 0.0),
    (True, "ABCDE", "A", "ABCDE", -0.04), (True, "ABCDEF", "A", "ABCDEF", -0.25),
    (False, "BCDEF", "A", "BCDEFG", -1.0), (True, "A", "AB", "A", 0.95), (True, "", "", "", 0.7),
    (False, "BC", "A", "BC", -0.4), (None, "A", "A", "A", 0.4), (True, "AA", "A", "AA", 1.0),
]


def test_golden_rewards(spark):
    prepare(spark)
    rows = [(i, c, list(l), list(r), list(e)) for i, (c, l, r, e, _) in enumerate(REWARDS)]
    schema = "i int, correct boolean, loaded array<string>, relevant array<string>, ever array<string>"
    out = reward.with_reward(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    for row, want in zip(out, REWARDS):
        assert row.reward == pytest.approx(want[4], abs=1e-9)
        assert -1.0 <= row.reward <= 1.0
        assert row.correctness == (0.6 if row.correct else 0.0)


def test_verification_text_keeps_negative_zero(spark):
    prepare(spark)
    rows = [(True, ["A"], ["A"], ["A"]), (False, ["B"], ["A"], ["B"])]
    df = spark.createDataFrame(rows, "correct boolean, loaded array<string>, relevant array<string>, ever array<string>")
    texts = [r[0] for r in reward.with_reward(df).select(reward.verification_message(F.col("correct"))).collect()]
    head = "CORRECT. Reward: correctness=0.60, precision=0.30, recall=0.10, "
    assert texts[0] == head + "bloat=-0.00, token_waste=-0.00, total=1.00"
    assert texts[1].startswith("INCORRECT. ") and texts[1].endswith("bloat=-0.15, token_waste=-0.05, total=-0.20")


def test_two_places_rounds_like_printf(spark):
    from episodica.functions.text import two_places

    values = [0.125, 0.375, 0.075, 0.005, 0.015, -0.125, -0.0, 0.0, 1.0, 0.994999, 0.995, -0.675, 2.5, 1 / 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[1] for r in df.select("i", two_places(F.col("v"))).orderBy("i").collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_observation_text(spark):
    prepare(spark)
    schema = (
        "task_description string, skill_catalog array<struct<id:string,name:string,description:string>>, "
        "loaded_skills array<string>, loaded_skill_contents map<string,string>, skill_content string, "
        "verification_result string, messages array<string>, context_budget_used int, context_budget_total int"
    )
    rows = [
        ("T", [("a", "A", "d1"), ("b", "B", "d2")], ["a", "b"], {"a": "same", "b": "same"}, "same", None, ["m1", "m2"], 2, 5),
        ("T", [], [], {}, None, "", [], 0, 5),
    ]
    texts = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(render.observation_text()).collect()]
    assert texts[0] == (
        "TASK: T\n\nSKILL CATALOG:\n- [a] A: d1\n- [b] B: d2\n\nCURRENTLY LOADED SKILLS: a, b\n\n"
        "JUST LOADED SKILL CONTENT:\nsame\n\nOTHER LOADED SKILL CONTENTS:\n\n[b]:\nsame\n\n"
        "STATUS: m2\n\nBUDGET USED: 2 / 5"
    )
    assert texts[1] == "TASK: T\n\nSKILL CATALOG:\n\nBUDGET USED: 0 / 5"
