"""Catalogs: which skills a task refers to, and what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.draws import draw, seeded_order
from episodica.plans.skew import SMALL_BYTES, keyed_join, ordered, planned_bytes

TASK_ROWS = 400_000  # rows of references in one partition
SHARES = 8  # partitions that a hot task, or a hot skill of it, is dealt to


def catalog_entry() -> Column:
    """What an agent sees of a skill; the full content is never read."""
    return F.struct(
        F.col("skill_id").alias("id"), "name", F.col("short_description").alias("description")
    )


def references(tasks: DataFrame) -> DataFrame:
    """One row per task and listed skill: relevant ones first, in list order."""
    tagged = F.concat(
        F.transform("relevant", lambda s: F.struct(s.alias("skill_id"), F.lit("relevant").alias("role"))),
        F.transform("distractors", lambda s: F.struct(s.alias("skill_id"), F.lit("distractor").alias("role"))),
    )
    rows = tasks.select("task_id", F.posexplode(tagged).alias("pos", "ref"))
    return rows.select("task_id", (F.col("pos") + 1).cast("long").alias("position"), "ref.*")


def placed(refs: DataFrame, order: list[str]) -> DataFrame:
    """Number references that come one per row: relevant first, then by ``order``."""
    refs = refs.withColumn("_late", (F.col("role") != "relevant").cast("int"))
    return ordered(refs, ["task_id"], ["_late", *order], number="position").drop("_late")


def assemble(refs: DataFrame, skills: DataFrame, strict: bool = True) -> DataFrame:
    """Catalog rows. Strict keeps references to unknown skills, marked ``found = false``."""
    known = skills.select("skill_id", "name", "short_description", F.lit(True).alias("found"))
    out = keyed_join(refs, known, ["skill_id"], "left" if strict else "inner")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def missing_skills(refs: DataFrame, skills: DataFrame) -> DataFrame:
    """Referenced skills that no skill row describes. Must be empty for a sound bank."""
    lost = keyed_join(refs, skills.select("skill_id"), ["skill_id"], "left_anti")
    return lost.groupBy("skill_id").agg(F.count(F.lit(1)).alias("references"))


def bank_integrity(refs: DataFrame, least: int = 5, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per task: catalog size, skills in both roles (relevant, or another), and whether the task is sound.

    Nearly every row is a group of its own, so rows are dealt before they are grouped: to as many partitions
    as keep each at about ``task_rows`` rows, whatever the size of the table. The rows of one task and skill
    go to SHARES of them, then the skills of one task, so neither needs to fit one partition.
    """
    spark = refs.sparkSession
    parts = spark.sparkContext.defaultParallelism
    if task_rows != TASK_ROWS or planned_bytes(refs) > SMALL_BYTES:
        parts = max(parts, -(-refs.count() // task_rows))
    share = F.pmod(F.xxhash64("skill_id"), F.lit(SHARES)).cast("int")
    rows = refs.select(
        "task_id", "skill_id", share.alias("_share"), F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int").alias("_salt"),
        (F.col("role") == "relevant").alias("_relevant"),
    )
    dealt = rows.repartition(parts, "task_id", "skill_id", "_salt").groupBy("task_id", "skill_id", "_share", "_salt").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_relevant").alias("_least"), F.max("_relevant").alias("_most")
    )
    per_skill = dealt.repartition(parts, "task_id", "_share").groupBy("task_id", "_share", "skill_id").agg(
        F.sum("_n").alias("_n"), (F.min("_least") != F.max("_most")).alias("_both")
    )
    per_share = per_skill.groupBy("task_id", "_share").agg(F.sum("_n").alias("_n"), F.count_if("_both").alias("_both"))
    sums = per_share.repartition(parts, "task_id").groupBy("task_id").agg(
        F.sum("_n").alias("catalog_size"), F.sum("_both").alias("overlap")
    )
    sound = (F.col("overlap") == 0) & (F.col("catalog_size") >= least)
    return sums.withColumn("sound", sound)


def contents_of(states: DataFrame, skills: DataFrame) -> DataFrame:
    """Map of loaded id to content, for known ids only. A state lists at most its budget."""
    held = states.select("episode_id", F.posexplode("loaded").alias("pos", "skill_id"))
    found = keyed_join(held, skills.select("skill_id", "full_content"), ["skill_id"])
    entries = F.array_sort(F.collect_list(F.struct("pos", "skill_id", "full_content")))
    maps = found.groupBy("episode_id").agg(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["skill_id"], e["full_content"]))
        ).alias("loaded_skill_contents")
    )
    return states.join(maps, "episode_id", "left")


def shuffled(ids: Column, seed: Column) -> Column:
    """Seeded order of a row's catalog."""
    return seeded_order(ids, seed)


def task_index(seed: Column, n_tasks: int) -> Column:
    """Position (from 0) of the task a seed picks."""
    return draw(n_tasks, "task", seed)


def sampled(pool: list[str], size: Column, *seed: Column | str) -> Column:
    """``size`` members of a fixed pool without replacement, in seeded order."""
    members = F.array(*[F.lit(p) for p in pool])
    return F.slice(seeded_order(members, *seed), F.lit(1), size)

