"""Queries over the action log: replay, rewards, roll-ups, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import render, replay, reward
from episodica.plans.registry import query
from episodica.plans.skew import keyed_join
from episodica.session import durable
from episodica.sources import bindings
from episodica.sources.tables import table

ACTIONS = """
a0 AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS episode_id,
         user_id, ts, event_id, event_type, value,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k
  FROM events),
a1 AS (
  SELECT *, CASE WHEN event_type = 'view' THEN 'load' WHEN event_type = 'click' THEN 'invoke'
                 WHEN event_type = 'error' THEN 'unload' WHEN event_type <> 'purchase' THEN event_type
                 WHEN value >= 60 THEN 'submit' WHEN value < 10 THEN 'unload' ELSE 'load' END AS action_type
  FROM a0),
a2 AS (
  SELECT episode_id, user_id, ts, event_id, action_type, value,
         CASE WHEN action_type = 'invoke' THEN 'load' WHEN action_type IN ('load', 'unload', 'submit')
              THEN action_type ELSE 'unknown' END AS kind,
         CASE WHEN action_type <> 'submit' AND k < 97 THEN 's' || (k % 9) END AS skill_id,
         row_number() OVER (PARTITION BY episode_id ORDER BY ts, event_id) AS step
  FROM a1),
a AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'submit' THEN 1 ELSE 0 END) OVER (
              PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
            AS after_done
  FROM a2)"""

TASKS = """
t AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS task_id, user_id,
         CASE user_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
         CASE WHEN user_id % 2 = 0 THEN 'bank' ELSE 'generated' END AS source,
         CASE WHEN user_id % 3 = 0 THEN ['s' || (user_id % 8), 's' || ((user_id + 3) % 8)]
              ELSE ['s' || (user_id % 8)] END AS relevant
  FROM events)"""

FOLD = f"""
WITH RECURSIVE {ACTIONS}, {TASKS},
r AS (
  SELECT DISTINCT episode_id, CAST(0 AS BIGINT) AS step, CAST('start' AS VARCHAR) AS outcome,
         CAST(NULL AS VARCHAR) AS skill_id, CAST(NULL AS VARCHAR) AS action_type,
         CAST([] AS VARCHAR[]) AS loaded, CAST([] AS VARCHAR[]) AS ever FROM a
  UNION ALL
  SELECT episode_id, step, outcome, skill_id, action_type,
         CASE outcome WHEN 'loaded' THEN list_append(loaded, skill_id)
                      WHEN 'unloaded' THEN [x FOR x IN loaded IF x <> skill_id] ELSE loaded END,
         CASE WHEN outcome = 'loaded' AND NOT list_contains(ever, skill_id)
              THEN list_append(ever, skill_id) ELSE ever END
  FROM (
    SELECT a.episode_id, a.step, a.skill_id, a.action_type, r.loaded, r.ever,
           CASE WHEN a.after_done THEN 'after_done' WHEN kind = 'unknown' THEN 'unknown_type'
                WHEN kind = 'submit' THEN 'submitted' WHEN a.skill_id IS NULL THEN 'missing_id'
                WHEN kind = 'load' AND a.skill_id = 's8' THEN 'not_in_catalog'
                WHEN kind = 'load' AND list_contains(r.loaded, a.skill_id) THEN 'already_loaded'
                WHEN kind = 'load' AND len(r.loaded) >= 5 THEN 'budget_full'
                WHEN kind = 'load' THEN 'loaded'
                WHEN list_contains(r.loaded, a.skill_id) THEN 'unloaded' ELSE 'not_loaded' END AS outcome
    FROM r JOIN a ON a.episode_id = r.episode_id AND a.step = r.step + 1)),
ends AS (SELECT episode_id, max(step) AS steps, arg_max(loaded, step) AS loaded, arg_max(ever, step) AS ever,
                bool_or(outcome = 'submitted') AS done FROM r GROUP BY episode_id),
state AS (
  SELECT ends.*, t.task_id, t.difficulty, t.source, t.relevant,
         (SELECT bool_or(value > 100) FROM a WHERE a.episode_id = ends.episode_id AND kind = 'submit'
            AND NOT after_done) AS correct
  FROM ends JOIN t ON t.task_id = split_part(ends.episode_id, '-', 1)),
terms AS (
  SELECT *, CASE WHEN correct THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS correctness,
         CASE WHEN len(loaded) = 0 THEN 0.0::DOUBLE
              ELSE 0.3::DOUBLE * (len(list_intersect(loaded, relevant))::DOUBLE / len(loaded)::DOUBLE) END AS precision_bonus,
         0.1::DOUBLE * (len(list_intersect(loaded, relevant))::DOUBLE / len(relevant)::DOUBLE) AS recall_bonus,
         -0.15::DOUBLE * len([x FOR x IN loaded IF NOT list_contains(relevant, x)])::DOUBLE AS bloat_penalty,
         -0.05::DOUBLE * len([x FOR x IN ever IF NOT list_contains(relevant, x)])::DOUBLE AS token_waste_penalty
  FROM state WHERE done),
rewards AS (
  SELECT *, greatest(correctness + precision_bonus + recall_bonus + bloat_penalty + token_waste_penalty,
                     -1.0::DOUBLE) AS reward
  FROM terms)
"""


def joined(ids):
    return F.array_join(ids, ",")


def staged(spark, folder, **sizes):
    setting = replay.settings(bindings.episodes(spark, folder), bindings.tasks(spark, folder))
    return replay.stage(bindings.actions(spark, folder), setting, ["ts", "event_id"], **sizes)


def with_relevant(states, spark, folder):
    """Episode states joined to the relevant ids of their task."""
    return keyed_join(states, bindings.tasks(spark, folder).select("task_id", "relevant"), ["task_id"])


def states(spark, folder):
    return replay.replay_state(staged(spark, folder))


def rewards(spark, folder):
    return reward.with_reward(with_relevant(states(spark, folder).where("done"), spark, folder))


def labelled_rewards(spark, folder):
    tasks = bindings.tasks(spark, folder).select("task_id", "relevant", "difficulty", "source")
    return reward.with_reward(keyed_join(states(spark, folder).where("done"), tasks, ["task_id"]))


@query(
    "action_normalise",
    f"WITH {ACTIONS} SELECT kind, count(*) AS actions, "
    "CAST(sum(CASE WHEN action_type = 'invoke' THEN 1 ELSE 0 END) AS BIGINT) AS aliased FROM a GROUP BY kind",
)
def action_normalise(spark, folder):
    rows = bindings.actions(spark, folder)
    return rows.groupBy(replay.normalise(F.col("action_type")).alias("kind")).agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if(F.col("action_type") == "invoke").alias("aliased"),
    )


@query(
    "after_done",
    f"WITH {ACTIONS} SELECT event_id, episode_id, step, 0.0::DOUBLE AS reward, true AS done FROM a WHERE after_done",
)
def after_done(spark, folder):
    """Actions after the first submit: still counted as steps, reward 0."""
    rows = staged(spark, folder).rows.where(F.col("code") == "after_done")
    return rows.select(
        "event_id", "episode_id", "step", F.lit(0.0).alias("reward"), F.lit(True).alias("done")
    )


@query("action_outcome", FOLD + "SELECT outcome, count(*) AS actions FROM r WHERE step > 0 GROUP BY outcome")
def action_outcome(spark, folder):
    steps = replay.replay_steps(staged(spark, folder))
    return steps.groupBy("outcome").agg(F.count(F.lit(1)).alias("actions"))


STEPS_SQL = FOLD + """
SELECT episode_id, step, outcome, skill_id, array_to_string(loaded, ',') AS loaded,
       array_to_string(ever, ',') AS ever, CAST(len(loaded) AS INTEGER) AS used FROM r WHERE step > 0"""


def _step_columns(steps):
    return steps.select(
        "episode_id", "step", "outcome", "skill_id",
        joined("loaded").alias("loaded"), joined("ever").alias("ever"), F.size("loaded").alias("used"),
    )


@query("replay_steps", STEPS_SQL)
def replay_steps(spark, folder):
    return _step_columns(replay.replay_steps(staged(spark, folder)))


@query("replay_pandas", STEPS_SQL)
def replay_pandas(spark, folder):
    """Replay through ordered Arrow streams for every episode."""
    return _step_columns(replay.replay_steps(staged(spark, folder), fold_rows=0))


@query(
    "replay_state",
    FOLD
    + """SELECT episode_id, task_id, steps, done, array_to_string(loaded, ',') AS loaded,
         array_to_string(ever, ',') AS ever, CAST(len(loaded) AS INTEGER) AS used,
         CAST(5 - len(loaded) AS INTEGER) AS remaining FROM state""",
)
def replay_state(spark, folder):
    return states(spark, folder).select(
        "episode_id", "task_id", "steps", "done", joined("loaded").alias("loaded"),
        joined("ever").alias("ever"), "used", "remaining",
    )


@query(
    "reward_episode",
    FOLD
    + """SELECT episode_id, task_id, steps, correct, correctness, round(precision_bonus, 9) AS precision_bonus,
         round(recall_bonus, 9) AS recall_bonus, round(bloat_penalty, 9) AS bloat_penalty,
         round(token_waste_penalty, 9) AS token_waste_penalty, round(reward, 9) AS reward FROM rewards""",
)
def reward_episode(spark, folder):
    terms = ["precision_bonus", "recall_bonus", "bloat_penalty", "token_waste_penalty", "reward"]
    return rewards(spark, folder).select(
        "episode_id", "task_id", "steps", "correct", "correctness",
        *[F.round(c, 9).alias(c) for c in terms],
    )


@query(
    "set_overlap",
    FOLD
    + """SELECT episode_id, array_to_string(list_sort(list_intersect(loaded, relevant)), ',') AS hits,
         CAST(len(list_intersect(loaded, relevant)) AS INTEGER) AS n_hits FROM state""",
)
def set_overlap(spark, folder):
    hits = F.array_intersect("loaded", "relevant")
    return with_relevant(states(spark, folder), spark, folder).select(
        "episode_id", joined(F.array_sort(hits)).alias("hits"), F.size(hits).alias("n_hits")
    )


@query(
    "set_waste",
    FOLD
    + """SELECT episode_id,
         array_to_string(list_sort([x FOR x IN loaded IF NOT list_contains(relevant, x)]), ',') AS unnecessary,
         array_to_string(list_sort([x FOR x IN ever IF NOT list_contains(relevant, x)]), ',') AS wasted FROM state""",
)
def set_waste(spark, folder):
    return with_relevant(states(spark, folder), spark, folder).select(
        "episode_id",
        joined(F.array_sort(F.array_except("loaded", "relevant"))).alias("unnecessary"),
        joined(F.array_sort(F.array_except("ever", "relevant"))).alias("wasted"),
    )


@query(
    "missed_skill_rate",
    FOLD
    + """SELECT count(*) AS episodes,
         round(avg(CASE WHEN len([x FOR x IN relevant IF NOT list_contains(ever, x)]) > 0 THEN 1.0 ELSE 0.0 END), 6)
           AS missed_rate,
         round(avg(CASE WHEN len(ever) > 0 THEN 1.0 ELSE 0.0 END), 6) AS load_rate FROM state""",
)
def missed_skill_rate(spark, folder):
    missed = reward.missed_skill().cast("double")
    return with_relevant(states(spark, folder), spark, folder).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.round(F.avg(missed), 6).alias("missed_rate"),
        F.round(F.avg((F.size("ever") > 0).cast("double")), 6).alias("load_rate"),
    )


@query(
    "reward_rollup",
    FOLD
    + """SELECT difficulty, source, CAST(grouping(difficulty) AS INTEGER) AS all_difficulty,
         CAST(grouping(source) AS INTEGER) AS all_source, count(*) AS episodes,
         round(avg(reward), 6) AS avg_reward, round(stddev_samp(reward), 6) AS std_reward,
         round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS correct_rate
       FROM rewards GROUP BY ROLLUP (difficulty, source)""",
)
def reward_rollup(spark, folder):
    out = reward.reward_rollup(labelled_rewards(spark, folder), ["difficulty", "source"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_reward", "std_reward", "correct_rate")})


@query(
    "group_advantage",
    FOLD
    + """, g AS (SELECT task_id, avg(reward) AS m, CASE WHEN max(reward) - min(reward) < 1e-9 THEN 0.0
                  ELSE stddev_pop(reward) END AS s FROM rewards GROUP BY task_id)
       SELECT episode_id, task_id, round(m, 6) AS group_mean, round(s, 6) AS group_std,
              round((reward - m) / nullif(s, 0), 6) AS advantage FROM rewards JOIN g USING (task_id)""",
)
def group_advantage(spark, folder):
    scored = durable(rewards(spark, folder).select("episode_id", "task_id", "reward"))
    out = reward.group_advantage(scored, ["task_id"])
    return out.select(
        "episode_id", "task_id",
        *[F.round(c, 6).alias(c) for c in ("group_mean", "group_std", "advantage")],
    )


VERIFICATION = """(CASE WHEN correct THEN 'CORRECT' ELSE 'INCORRECT' END || printf(
  '. Reward: correctness=%.2f, precision=%.2f, recall=%.2f, bloat=%.2f, token_waste=%.2f, total=%.2f',
  correctness, precision_bonus, recall_bonus, bloat_penalty, token_waste_penalty, reward))"""


@query("verification_message", FOLD + f"SELECT episode_id, {VERIFICATION} AS message FROM rewards")
def verification_message(spark, folder):
    return rewards(spark, folder).select(
        "episode_id", reward.verification_message(F.col("correct")).alias("message")
    )


@query(
    "step_message",
    FOLD
    + f"""SELECT r.episode_id, r.step, CASE r.outcome
           WHEN 'loaded' THEN 'Loaded skill ''Skill ' || r.skill_id || ''' (' || r.skill_id || '). Context: ' || len(r.loaded) || '/5'
           WHEN 'unloaded' THEN 'Unloaded skill ''Skill ' || r.skill_id || ''' (' || r.skill_id || '). Context: ' || len(r.loaded) || '/5'
           WHEN 'already_loaded' THEN 'Skill ' || r.skill_id || ' already loaded.'
           WHEN 'budget_full' THEN 'Context budget full (5 skills loaded). Unload a skill first.'
           WHEN 'missing_id' THEN (CASE WHEN r.action_type = 'invoke' THEN 'load' ELSE r.action_type END) || ' action requires skill_id'
           WHEN 'not_in_catalog' THEN 'Skill ' || r.skill_id || ' not in current catalog.'
           WHEN 'not_loaded' THEN 'Skill ' || r.skill_id || ' is not currently loaded.'
           WHEN 'unknown_type' THEN 'Unknown action_type: ' || r.action_type
           WHEN 'after_done' THEN 'Episode already done. Call reset().'
           WHEN 'submitted' THEN 'Submitted answer. ' || {VERIFICATION} END AS message
         FROM r LEFT JOIN rewards USING (episode_id) WHERE r.step > 0""",
)
def step_message(spark, folder):
    """One message per action; the submit line carries the reward of its episode.

    The lists after a submit are the lists at the submit, so one replay serves both.
    """
    steps = with_relevant(replay.replay_steps(staged(spark, folder)), spark, folder)
    verdict = reward.verification_message(F.col("correct"))
    scored = reward.with_reward(render.with_names(steps, bindings.skills(spark, folder))).withColumn("verdict", verdict)
    return scored.select("episode_id", "step", render.step_message().alias("message"))


@query(
    "replay_rejects",
    f"""WITH {ACTIONS} SELECT event_id, episode_id, action_type FROM a WHERE episode_id NOT IN (
          SELECT episode_id FROM a WHERE action_type = 'signup')""",
)
def replay_rejects(spark, folder):
    """Actions of episodes without a sign-up, read as episodes that were never started."""
    rows = bindings.actions(spark, folder).select("event_id", "episode_id", "action_type")
    return replay.rejected(rows, rows.where("action_type = 'signup'"))


@query(
    "episode_restarts",
    """SELECT CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS episode_id, count(*) AS starts
       FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 1""",
)
def episode_restarts(spark, folder):
    """Purchases as starts: episode ids that were started more than once, which a log must not hold."""
    rows = table(spark, folder, "events").where("event_type = 'purchase'")
    return replay.restarted(rows.select(bindings.episode_of(F.col("user_id"), F.col("ts")).alias("episode_id")))
