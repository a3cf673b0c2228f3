"""Reward of a submitted episode, and roll-ups over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import two_places
from episodica.plans.skew import keyed_join

# Fixed values of the reward rule.
CORRECT, PRECISION, RECALL, BLOAT, WASTE, FLOOR = 0.6, 0.3, 0.1, -0.15, -0.05, -1.0
EQUAL = 1e-9


def with_reward(
    df: DataFrame, correct="correct", loaded="loaded", ever="ever", relevant="relevant"
) -> DataFrame:
    """Add the five terms and their sum, all DOUBLE. The order of the sum is fixed.

    Lists may hold an id twice; they are compared as sets.
    """
    held, needed = F.array_distinct(loaded), F.array_distinct(relevant)
    hits = F.size(F.array_intersect(held, needed))
    extra = F.size(F.array_except(held, needed))
    wasted = F.size(F.array_except(F.array_distinct(ever), needed))
    total = F.col("correctness") + F.col("precision_bonus") + F.col("recall_bonus")
    total = total + F.col("bloat_penalty") + F.col("token_waste_penalty")
    none_held, none_needed = F.size(held) == 0, F.size(needed) == 0
    return df.withColumns(
        {
            "correctness": F.when(F.col(correct), F.lit(CORRECT)).otherwise(F.lit(0.0)),
            "precision_bonus": F.lit(PRECISION)
            * F.when(none_held, F.lit(0.0)).otherwise(hits / F.nullif(F.size(held), F.lit(0))),
            "recall_bonus": F.lit(RECALL)
            * F.when(none_needed, F.lit(1.0)).otherwise(hits / F.nullif(F.size(needed), F.lit(0))),
            "bloat_penalty": F.lit(BLOAT) * extra.cast("double"),
            "token_waste_penalty": F.lit(WASTE) * wasted.cast("double"),
        }
    ).withColumn("reward", F.greatest(total, F.lit(FLOOR)))


def verification_message(correct: Column) -> Column:
    """Text shown after a submit."""
    terms = ("correctness", "precision_bonus", "recall_bonus", "bloat_penalty", "token_waste_penalty")
    return F.format_string(
        "%s. Reward: correctness=%s, precision=%s, recall=%s, bloat=%s, token_waste=%s, total=%s",
        F.when(correct, "CORRECT").otherwise("INCORRECT"),
        *[two_places(F.col(c)) for c in (*terms, "reward")],
    )


def reward_rollup(rewards: DataFrame, levels: list[str]) -> DataFrame:
    """Roll-up by the given levels with partial sums before the shuffle."""
    marks = [F.grouping(c).cast("int").alias(f"all_{c}") for c in levels]
    return rewards.rollup(*levels).agg(
        *marks,
        F.count(F.lit(1)).alias("episodes"),
        F.avg("reward").alias("avg_reward"),
        F.stddev_samp("reward").alias("std_reward"),
        F.avg(F.col("correct").cast("double")).alias("correct_rate"),
    )


def group_advantage(rewards: DataFrame, group: list[str]) -> DataFrame:
    """Reward relative to its group: (reward - mean) / population deviation.

    The group figures are aggregated first and joined back, so a group may be of any size.
    Null where all rewards are equal. Equal rewards may differ in their last bits, by the
    order of their terms, so a spread below ``EQUAL`` counts as none.
    """
    figures = rewards.groupBy(*group).agg(
        F.avg("reward").alias("group_mean"),
        F.stddev_pop("reward").alias("group_std"),
        F.min("reward").alias("_low"),
        F.max("reward").alias("_high"),
    )
    flat = F.col("_high") - F.col("_low") < EQUAL
    figures = figures.withColumn("group_std", F.when(flat, F.lit(0.0)).otherwise(F.col("group_std")))
    gap = F.col("reward") - F.col("group_mean")
    return keyed_join(rewards, figures.drop("_low", "_high"), group).withColumn(
        "advantage", gap / F.nullif(F.col("group_std"), F.lit(0.0))
    )


def missed_skill(relevant="relevant", ever="ever") -> Column:
    return F.size(F.array_except(relevant, ever)) > 0
