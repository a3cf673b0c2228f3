"""Views that read the star-schema tables as episode logs, banks, levels and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.text import strip
from episodica.sources.tables import table

CATALOG = [f"s{i}" for i in range(8)]


def payload_number(props: Column) -> Column:
    """The number of a payload; null where it has none or no valid one."""
    return F.get_json_object(props, "$.k").try_cast("int")


def episode_of(user: Column, ts: Column) -> Column:
    return F.concat_ws("-", user.cast("string"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"))


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as load / invoke / unload / submit actions; one episode per user and week."""
    return actions_of(table(spark, folder, "events"))


def actions_of(events: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    action = (
        F.when(kind == "view", "load")
        .when(kind == "click", "invoke")
        .when(kind == "error", "unload")
        .when(kind != "purchase", kind)
        .when(value >= 60, "submit")
        .when(value < 10, "unload")
        .otherwise("load")
    )
    rows = events.select(
        episode_of(F.col("user_id"), F.col("ts")).alias("episode_id"),
        "user_id", "ts", "event_id", action.alias("action_type"), "value",
        payload_number(F.col("props")).alias("k"),
    )
    submit, k = F.col("action_type") == "submit", F.col("k")
    skill = F.when(~submit & (k < 97), F.concat(F.lit("s"), (k % 9).cast("string")))
    return rows.withColumns({"skill_id": skill, "correct": F.when(submit, value > 100)}).drop("value", "k")


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return (
        events.groupBy(episode_of(F.col("user_id"), F.col("ts")).alias("episode_id"))
        .agg(F.first("user_id").cast("string").alias("task_id"))
        .withColumn("context_budget", F.lit(5))
    )


def _numbered(user: Column) -> Column:
    return F.concat(F.lit("s"), F.pmod(user, F.lit(8)).cast("string"))


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One task per user: one or two relevant skills, the rest of the catalog distracts."""
    user = F.col("user_id")
    both = F.array(_numbered(user), _numbered(user + 3))
    relevant = F.when(user % 3 == 0, both).otherwise(F.array(_numbered(user)))
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (user % 3 + 1).cast("int"))
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.select(
        user.cast("string").alias("task_id"),
        level.alias("difficulty"),
        F.when(user % 2 == 0, "bank").otherwise("generated").alias("source"),
        F.concat(F.lit("Task of user "), user.cast("string")).alias("description"),
        relevant.alias("relevant"),
        F.array_except(F.array(*map(F.lit, CATALOG)), relevant).alias("distractors"),
    )


def skills(spark: SparkSession, folder: str) -> DataFrame:
    """The skills the logged actions name, one row each."""
    logged = actions(spark, folder).select("skill_id").where("skill_id is not null").distinct()
    return logged.select(
        "skill_id",
        F.concat(F.lit("Skill "), "skill_id").alias("name"),
        F.concat(F.lit("About "), "skill_id").alias("short_description"),
        F.concat(F.lit("Content of "), "skill_id").alias("full_content"),
    )


def bank_references(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as task-to-skill references: returned lines are relevant."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("task_id"),
        F.col("l_partkey").cast("string").alias("skill_id"),
        F.when(F.col("l_returnflag") == "R", "relevant").otherwise("distractor").alias("role"),
        "l_linenumber",
    )


def bank_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Parts below size 48 as skills, so that some references are missing."""
    part = table(spark, folder, "part").where("p_size < 48")
    return part.select(
        F.col("p_partkey").cast("string").alias("skill_id"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_brand", "p_type").alias("short_description"),
        F.concat_ws("\n", "p_name", "p_brand", "p_type", F.col("p_retailprice").cast("string")).alias("full_content"),
    )


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """Events as gauge readings: the user is the station, its id with leading zeros."""
    return table(spark, folder, "events").select(
        "event_id", station_id(F.col("user_id")).alias("station_id"), "ts",
        F.col("value").alias("level"), F.col("event_type").alias("parameter"),
    )


def station_id(user: Column) -> Column:
    return F.lpad(user.cast("string"), 8, "0")


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Flood stage 40 + user mod 40 per station, with one class below and two above."""
    flood = (F.lit(40) + F.col("user_id") % 40).cast("double")
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.select(
        station_id(F.col("user_id")).alias("station_id"), flood.alias("flood"),
        (flood - 10).alias("action"), (flood + 150).alias("moderate"), (flood + 300).alias("major"),
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals as versions of a customer row, ties by order key."""
    return table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.col("o_totalprice").alias("value")
    )


def priority_series(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly order totals by priority; ``t`` counts months from January 1995."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("t"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    )


def script_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as scripts: one scene per turn, every line of its text a script line.

    Lines of users become numbered options, lines of assistants point at the next turn,
    and lines of other roles have no arrow.
    """
    turns = table(spark, folder, "conversations")
    parts = F.concat(F.array(F.lit("")), F.split("text", "\n"))
    rows = turns.select("conv_id", "turn", "role", F.posexplode(parts).alias("pos", "part"))
    said = strip(F.col("part"))
    target = F.concat(F.lit(" -> T"), F.col("turn") + 1)
    line = (
        F.when(F.col("pos") == 0, F.concat(F.lit("[T"), "turn", F.lit("]")))
        .when(said == "", "")
        .when(F.col("role") == "user", F.concat("pos", F.lit(". "), said, target))
        .when(F.col("role") == "assistant", F.concat("role", F.lit(": "), said, target))
        .otherwise(F.concat("role", F.lit(": "), said))
    )
    rows = rows.select(F.col("conv_id").alias("script_id"), "turn", "pos", line.alias("line"))
    return rows.where("line <> ''")
