"""Texts an agent sees: step messages, tool results and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.plans.skew import keyed_join


def with_names(steps: DataFrame, skills: DataFrame) -> DataFrame:
    """Add the display name of each step's skill (null where it has none)."""
    names = skills.select("skill_id", F.col("name").alias("skill_name"))
    return keyed_join(steps, names, ["skill_id"], "left")


def step_message() -> Column:
    """Message per outcome, from the columns of ``replay_steps`` plus name and verdict."""
    skill, used, total = F.col("skill_id"), F.size("loaded"), F.col("budget")
    verb = F.when(F.col("action_type") == "invoke", "load").otherwise(F.col("action_type"))
    # Fixed message formats.
    texts = {
        "loaded": F.format_string("Loaded skill '%s' (%s). Context: %d/%d", F.col("skill_name"), skill, used, total),
        "unloaded": F.format_string("Unloaded skill '%s' (%s). Context: %d/%d", F.col("skill_name"), skill, used, total),
        "already_loaded": F.format_string("Skill %s already loaded.", skill),
        "budget_full": F.format_string("Context budget full (%d skills loaded). Unload a skill first.", total),
        "missing_id": F.format_string("%s action requires skill_id", verb),
        "unknown_skill": F.format_string("Unknown skill_id: %s", skill),
        "not_in_catalog": F.format_string("Skill %s not in current catalog.", skill),
        "not_loaded": F.format_string("Skill %s is not currently loaded.", skill),
        "unknown_type": F.format_string("Unknown action_type: %s", F.col("action_type")),
        "after_done": F.lit("Episode already done. Call reset()."),
        "submitted": F.format_string("Submitted answer. %s", F.col("verdict")),
    }
    return F.coalesce(*[F.when(F.col("outcome") == o, text) for o, text in texts.items()])


def start_message(task_id: Column, difficulty: Column) -> Column:
    return F.format_string("Episode started. Task: %s (%s)", task_id, difficulty)


def tool_result(content: Column) -> Column:
    """Text returned to the agent by load, unload and submit."""
    skill, used, total = F.col("skill_id"), F.size("loaded"), F.col("budget")
    body = F.coalesce(F.nullif(content, F.lit("")), F.lit("No content returned."))
    kind = F.when(F.col("action_type") == "invoke", "load").otherwise(F.col("action_type"))
    return (
        F.when(kind == "load", F.format_string("[%s] loaded (budget: %d/%d):\n%s", skill, used, total, body))
        .when(kind == "unload", F.format_string("Unloaded %s. Budget: %d/%d", skill, used, total))
        .when(kind == "submit", F.lit("Answer submitted and recorded. Episode complete."))
    )


def observation_text() -> Column:
    """Full text of an observation; a section appears only when it has content.

    The skill just loaded is the first one, in load order, whose content is the content
    shown; it is left out of the other contents.
    """
    loaded, contents, shown = F.col("loaded_skills"), F.col("loaded_skill_contents"), F.col("skill_content")
    has_shown = F.coalesce(F.length(shown) > 0, F.lit(False))
    same = F.filter(loaded, lambda s: F.try_element_at(contents, s) == shown)
    just = F.when(has_shown, F.try_element_at(same, F.lit(1)))
    present = F.filter(loaded, lambda s: F.map_contains_key(contents, s))
    others = F.filter(present, lambda s: ~s.eqNullSafe(just))
    catalog = F.transform(
        "skill_catalog",
        lambda s: F.concat(F.lit("- ["), s["id"], F.lit("] "), s["name"], F.lit(": "), s["description"]),
    )
    other_texts = F.transform(
        others, lambda s: F.concat(F.lit("\n["), s, F.lit("]:\n"), F.element_at(contents, s))
    )
    verdict = F.col("verification_result")
    last = F.try_element_at("messages", F.lit(-1))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("TASK: "), F.col("task_description"), F.lit("\n\nSKILL CATALOG:")),
        F.array_join(F.when(F.size(catalog) > 0, catalog), "\n"),
        F.when(F.size(loaded) > 0, F.concat(F.lit("\nCURRENTLY LOADED SKILLS: "), F.array_join(loaded, ", "))),
        F.when(has_shown, F.concat(F.lit("\nJUST LOADED SKILL CONTENT:\n"), shown)),
        F.when(F.size(others) > 0, F.lit("\nOTHER LOADED SKILL CONTENTS:")),
        F.when(F.size(others) > 0, F.array_join(other_texts, "\n")),
        F.when(F.length(verdict) > 0, F.concat(F.lit("\nVERIFICATION: "), verdict)),
        F.when(last.isNotNull(), F.concat(F.lit("\nSTATUS: "), last)),
        F.format_string("\nBUDGET USED: %d / %d", F.col("context_budget_used"), F.col("context_budget_total")),
    )
