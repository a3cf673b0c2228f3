"""One observation row per step: what the agent sees after each action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators import render, reward
from episodica.operators.catalog import references
from episodica.plans.skew import keyed_join


def task_book(tasks: DataFrame, skills: DataFrame) -> DataFrame:
    """Per task: its texts, catalog entries and the content of every catalog skill.

    References to unknown skills are skipped. A list holds at most one task's catalog.
    """
    refs = keyed_join(
        references(tasks), skills.select("skill_id", "name", "short_description", "full_content"), ["skill_id"]
    )
    entry = F.struct(
        "position", F.col("skill_id").alias("id"), "name", F.col("short_description").alias("description"), "full_content"
    )
    listed = refs.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    book = tasks.select("task_id", "description", "difficulty", "relevant").join(listed, "task_id", "left")
    entries = F.coalesce("entries", F.array().cast(dict(listed.dtypes)["entries"]))
    return book.withColumn("entries", entries).select(
        "task_id", "description", "difficulty", "relevant",
        F.transform("entries", lambda e: F.struct(e["id"], e["name"], e["description"])).alias("skill_catalog"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["id"], e["full_content"]))).alias("contents"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["id"], e["name"]))).alias("names"),
    )


def _when(*outcomes: str) -> Column:
    return F.col("outcome").isin(*outcomes)


def observations(steps: DataFrame, book: DataFrame) -> DataFrame:
    """Observation columns for the rows of ``replay_steps``.

    Texts come with the task, so no step is exploded over its loaded skills. ``message``
    is the line this step adds to the log.
    """
    rows = reward.with_reward(keyed_join(steps, book, ["task_id"]))
    verdict = reward.verification_message(F.col("correct"))
    present = F.filter("loaded", lambda s: F.map_contains_key("contents", s))
    rows = rows.withColumns(
        {"verdict": verdict, "skill_name": F.try_element_at("names", F.col("skill_id"))}
    )
    return rows.select(
        "episode_id", "step", "outcome",
        F.col("description").alias("task_description"), "skill_catalog", "difficulty",
        F.col("loaded").alias("loaded_skills"),
        F.map_from_arrays(
            present, F.transform(present, lambda s: F.element_at("contents", s))
        ).alias("loaded_skill_contents"),
        F.size("loaded").alias("context_budget_used"),
        F.col("budget").alias("context_budget_total"),
        F.when(_when("loaded", "already_loaded"), F.try_element_at("contents", F.col("skill_id"))).alias("skill_content"),
        (F.col("budget") - F.size("loaded")).alias("remaining_invocations"),
        F.when(_when("submitted"), F.col("verdict"))
        .when(_when("after_done"), "Episode already finished.").alias("verification_result"),
        F.col("ever").alias("skills_invoked"),
        render.step_message().alias("message"),
        _when("submitted", "after_done").alias("done"),
        F.when(_when("submitted"), F.col("reward")).otherwise(0.0).alias("reward"),
    )
