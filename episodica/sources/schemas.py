"""Explicit schemas of the package's own tables and payloads; nothing is inferred."""

SKILLS = "skill_id STRING, name STRING, short_description STRING, full_content STRING, seed BIGINT"

TASKS = (
    "task_id STRING, difficulty STRING, description STRING, relevant ARRAY<STRING>, "
    "distractors ARRAY<STRING>, verifier_kind STRING, source STRING, template STRING"
)

ACTIONS = (
    "episode_id STRING, step INT, ts TIMESTAMP, action_type STRING, skill_id STRING, answer STRING"
)

OBSERVATION = (
    "task_description STRING, skill_catalog ARRAY<STRUCT<id: STRING, name: STRING, description: STRING>>, "
    "difficulty STRING, loaded_skills ARRAY<STRING>, loaded_skill_contents MAP<STRING, STRING>, "
    "context_budget_used INT, context_budget_total INT, skill_content STRING, remaining_invocations INT, "
    "verification_result STRING, skills_invoked ARRAY<STRING>, messages ARRAY<STRING>, "
    "metadata MAP<STRING, STRING>"
)

RESULT = f"observation STRUCT<{OBSERVATION}>, reward DOUBLE, done BOOLEAN"

STATE = (
    "episode_id STRING, step_count INT, task_id STRING, loaded_skills ARRAY<STRING>, "
    "skills_ever_loaded ARRAY<STRING>, skills_invoked ARRAY<STRING>, difficulty STRING, done BOOLEAN, "
    "context_budget_total INT, remaining_invocations INT"
)

ROLLOUT = (
    "canary STRUCT<phases: ARRAY<STRUCT<name: STRING, traffic_pct: INT, duration_min: INT, metrics_gate: STRING>>, "
    "rollback: STRUCT<auto: BOOLEAN, on_metric_breach: STRING, cooldown_min: INT>>"
)

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
