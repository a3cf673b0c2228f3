"""Grading of submissions: text rules, golden results, rollout documents and graphs.

Text rules are evaluated on the submission row itself, as one literal expression per
rule, so grading needs no shuffle and no exploded (submission, rule) rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import DIALECT, in_order
from episodica.plans.skew import keyed_join


@dataclass(frozen=True)
class Check:
    """One condition on a text. ``kind``: regex, contains, order or count."""

    kind: str
    pattern: str
    flags: str = ""
    least: int = 1

    def holds(self, text: Column) -> Column:
        if self.kind == "contains":
            return F.contains(text, F.lit(self.pattern))
        if self.kind == "order":
            return in_order(text, self.pattern.split(" < "))
        pattern = F.lit(f"{DIALECT}(?{self.flags}){self.pattern}" if self.flags else DIALECT + self.pattern)
        if self.kind == "count":
            return F.regexp_count(text, pattern) >= self.least
        return F.rlike(text, pattern)


@dataclass(frozen=True)
class Rule:
    """A check of one part of a task: all of its tests must hold."""

    task_id: str
    part: int
    tests: tuple[Check, ...]


def _regex(pattern: str, flags: str = "") -> Check:
    return Check("regex", pattern, flags)


def _has(text: str) -> Check:
    return Check("contains", text)


# The rules of each text-graded task, in order.
RULES = [
    Rule("task_003", 1, (_regex(r"HLX-(IO|NET|AUTH|DATA|SYS)-\d{4}"),)),
    Rule("task_003", 1, (_regex(r"try!\s*\w+"),)),
    Rule("task_003", 1, (_regex(r"with_context\s*\("),)),
    Rule("task_003", 1, (_regex(r"retry.*backoff|retry_with_backoff", "i"),)),
    Rule("task_003", 1, (_regex(r"helix\.log\.error\s*\("),)),
    Rule("task_003", 1, (_regex(r"result\s*<|Ok\s*\(|Err\s*\("),)),
    Rule("task_005", 1, (_regex(r"TEMPORAL_AVG\s*\(", "i"),)),
    Rule("task_005", 1, (_regex(r"TEMPORAL_MAX\s*\(", "i"),)),
    Rule("task_005", 1, (_regex(r"""BETWEEN\s+TIMESTAMP\s+['"]2024-01-01.*AND\s+TIMESTAMP\s+['"]2024-03-01""", "is"),)),
    Rule("task_005", 1, (_regex(r"WINDOW\s+TUMBLING\s*\(", "i"),)),
    Rule("task_005", 1, (_regex(r"GROUP\s+BY\s+product_id", "i"),)),
    Rule("task_005", 1, (_regex(r"""INTERVAL\s+['"]?1\s*day""", "i"),)),
    Rule("task_006", 1, (
        _has("vault-sync rotate prepare"), _has("vault-sync rotate activate"),
        _has("vault-sync rotate verify"), _has("vault-sync rotate commit"),
        Check("order", "rotate prepare < rotate activate < rotate verify < rotate commit"),
    )),
    Rule("task_006", 1, (_has("vault-sync rotate rollback"),)),
    Rule("task_006", 1, (_has("--grace-period"),)),
    Rule("task_006", 1, (_has("--probe-endpoint"),)),
    Rule("task_006", 1, (_regex(r"\bif\b|\bthen\b|\$\?|&&\s*vault-sync|\|\|"),)),
    Rule("task_006", 1, (_has("db/prod/password"),)),
    Rule("task_007", 1, (_regex(r"pipeline\s+order_analytics\s*\{"),)),
    Rule("task_007", 1, (_regex(r"""source\s+kafka\s*\(\s*["']order-events"""),)),
    Rule("task_007", 1, (_regex(r"filter\s*\("), _has("completed"), _has("refunded"))),
    Rule("task_007", 1, (_regex(r"window\s*\(\s*tumbling\s*=\s*5m"),)),
    Rule("task_007", 1, (_regex(r"group_by.*product_id"),)),
    Rule("task_007", 1, (_regex(r"branch\s*\{"), _has("sink"))),
    Rule("task_007", 1, (_regex(r"error_handler\s*\{"), _has("dead_letter"))),
    Rule("task_007", 1, (_regex(r"\bcount\b", "i"), _regex(r"\bsum\b", "i"))),
    Rule("task_009", 1, (_regex(r"TEMPORAL\s+JOIN", "i"),)),
    Rule("task_009", 1, (_regex(r"AS\s+OF\s+(TIMESTAMP|INTERVAL)", "i"),)),
    Rule("task_009", 1, (_regex(r"\bON\b.*\bid\b", "i"),)),
    Rule("task_009", 2, (_regex(r"rotation_interval:\s*7d"),)),
    Rule("task_009", 2, (_has("grace_period:"),)),
    Rule("task_009", 2, (_regex(r"http_probe|probe.*endpoint", "i"),)),
    Rule("task_009", 2, (_regex(r"slack:", "i"),)),
    Rule("task_009", 3, (_regex(r"SecretClient|secret\s*\("),)),
    Rule("task_009", 3, (_regex(r"on_rotate|\.on_rotate"),)),
    Rule("task_010", 1, (_regex(r"name:\s*shadow"),)),
    Rule("task_010", 1, (Check("count", r"-\s*name:", least=5),)),
    Rule("task_010", 1, (_regex(r"metrics_gate:.*latency", "i"),)),
    Rule("task_010", 1, (_regex(r"metrics_gate:.*error_rate", "i"),)),
    Rule("task_010", 1, (_regex(r"traffic_pct:\s*100"),)),
    Rule("task_010", 2, (_regex(r"pipeline\s+deploy_monitor\s*\{"),)),
    Rule("task_010", 2, (_regex(r"source\s+kafka\s*\("),)),
    Rule("task_010", 2, (_regex(r"window\s*\(\s*tumbling\s*=\s*1m"),)),
    Rule("task_010", 2, (_regex(r"branch\s*\{"), _has("error_rate"))),
    Rule("task_010", 3, (_regex(r"arc\s+deploy\s+(init|start)"),)),
    Rule("task_010", 3, (_regex(r"flux\s+deploy"),)),
]

# The text form of the rollout check.
ROLLOUT_RULES = [
    Rule("task_004", 1, (_regex(r"name:\s*shadow"), _regex(r"traffic_pct:\s*0\b"))),
    Rule("task_004", 1, (_regex(r"name:\s*canary_1"),)),
    Rule("task_004", 1, (_regex(r"traffic_pct:\s*100"),)),
    Rule("task_004", 1, (_regex(r"metrics_gate:.*error_rate"),)),
    Rule("task_004", 1, (_regex(r"auto:\s*true", "i"),)),
    Rule("task_004", 1, (Check("count", r"-\s*name:", least=5),)),
]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _rules_by_task(rules: list[Rule]) -> dict[str, list[Rule]]:
    grouped: dict[str, list[Rule]] = {}
    for rule in rules:
        grouped.setdefault(rule.task_id, []).append(rule)
    return grouped


def _per_task(by_task: dict[str, Column]) -> Column:
    out = F.lit(None)
    for task_id, value in by_task.items():
        out = F.when(F.col("task_id") == task_id, value).otherwise(out)
    return out


def check_results(submissions: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add ``checks``: one boolean per rule of the task (null where it has no rules)."""
    text = F.coalesce("answer", F.lit(""))
    per_task = {
        task: F.array(*[_all([t.holds(text) for t in rule.tests]) for rule in listed])
        for task, listed in _rules_by_task(rules).items()
    }
    return submissions.withColumn("checks", _per_task(per_task).cast("array<boolean>"))


def grade_structural(
    submissions: DataFrame,
    rules: list[Rule] = RULES,
    hooks: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``correct`` when every rule of the task holds; a task without rules passes.

    ``hooks`` maps a task to a function text -> boolean column (a pandas UDF, say) for
    checks no rule kind covers.
    """
    graded = check_results(submissions, rules)
    correct = F.coalesce(F.forall("checks", lambda ok: ok), F.lit(True))
    for task_id, hook in (hooks or {}).items():
        extra = F.coalesce(hook(F.coalesce("answer", F.lit(""))), F.lit(False))
        correct = correct & F.when(F.col("task_id") == task_id, extra).otherwise(True)
    return graded.withColumn("correct", correct)


def grade_parts(submissions: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per submission and part: rules passed, rules in all, and whether all hold."""
    parts = {
        task: F.array(*[F.lit(rule.part) for rule in listed])
        for task, listed in _rules_by_task(rules).items()
    }
    graded = check_results(submissions, rules).withColumn("parts", _per_task(parts).cast("array<int>"))
    rows = graded.withColumn("part", F.explode(F.array_distinct("parts")))
    mine = F.filter(
        F.arrays_zip("parts", "checks"), lambda pair: pair["parts"] == F.col("part")
    )
    passed = F.size(F.filter(mine, lambda pair: pair["checks"]))
    return rows.select(
        *submissions.columns, "part", passed.alias("passed"), F.size(mine).alias("rules"),
        (passed == F.size(mine)).alias("part_ok"),
    )


def same_value(value: Column, expected: Column, tolerance: Column) -> Column:
    """JSON texts are equal, or are numbers closer than the tolerance."""
    close = F.abs(value.try_cast("double") - expected.try_cast("double")) < tolerance
    return F.coalesce(value == expected, F.lit(False)) | F.coalesce(close, F.lit(False))


def grade_cases(
    submissions: DataFrame, results: DataFrame, cases: DataFrame,
    hooks: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """``correct`` when the table of results meets every golden case of the task.

    A missing or null result is a fail; so is any result with an ``error``. Passed cases
    are counted before they meet the submissions, so nothing is expanded per case.
    ``hooks`` maps a task to its own test (value, expected) -> boolean column.
    """
    golden = cases.select("task_id", "case_id", "expected", "tolerance")
    met = keyed_join(results, golden, ["task_id", "case_id"])
    value, expected = F.col("value"), F.col("expected")
    ok = same_value(value, expected, F.col("tolerance"))
    for task_id, hook in (hooks or {}).items():
        own = F.coalesce(hook(value, expected), F.lit(False))
        ok = F.when(F.col("task_id") == task_id, own).otherwise(ok)
    ok = ok & F.col("error").isNull()
    # Dealt once by submission: both groupings and the join back need no further shuffle.
    passed = (
        met.repartition("submission_id", "task_id").groupBy("submission_id", "task_id", "case_id")
        .agg(F.bool_and(ok).alias("_ok"))
        .groupBy("submission_id", "task_id")
        .agg(F.count_if("_ok").alias("passed"))
    )
    needed = cases.groupBy("task_id").agg(F.count_distinct("case_id").alias("cases"))
    graded = keyed_join(submissions.join(passed, ["submission_id", "task_id"], "left"), needed, ["task_id"], "left")
    passed_n, cases_n = F.coalesce("passed", F.lit(0)), F.coalesce("cases", F.lit(0))
    return graded.withColumns({"passed": passed_n, "cases": cases_n}).withColumn(
        "correct", F.col("passed") == F.col("cases")
    )


def rollout_failures(config: Column) -> Column:
    """Names of the rollout rules a parsed document breaks; empty means it passes.

    An absent traffic share counts as 0. A gate that is present but null counts as absent,
    since a struct cannot tell the two apart.
    """
    phases, rollback = config["canary"]["phases"], config["canary"]["rollback"]
    first, last = F.try_element_at(phases, F.lit(1)), F.try_element_at(phases, F.lit(-1))
    traffic = F.transform(phases, lambda p: F.coalesce(p["traffic_pct"], F.lit(0)))
    gated = F.forall(
        phases, lambda p: (F.coalesce(p["traffic_pct"], F.lit(0)) >= 100) | p["metrics_gate"].isNotNull()
    )
    rules = {
        "phases": F.size(phases) >= 5,
        "first": (first["name"] == "shadow") & (first["traffic_pct"] == 0),
        "last": last["traffic_pct"] == 100,
        "order": F.array_sort(traffic) == traffic,
        "gate": gated,
        "rollback": rollback["auto"],
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def grade_graph(
    nodes: DataFrame, edges: DataFrame, n_nodes: int, n_edges: int,
    need_nodes: list[Column], need_edges: list[Column],
) -> DataFrame:
    """``correct`` when a graph has the exact counts and some row for every condition.

    Conditions are literal columns over node and edge rows, so each side is one
    aggregate with partial results before the shuffle.
    """
    def found(conditions: list[Column]) -> Column:
        return _all([F.coalesce(F.bool_or(c), F.lit(False)) for c in conditions])

    per_node = nodes.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), found(need_nodes).alias("nodes_found")
    )
    per_edge = edges.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_edges"), found(need_edges).alias("edges_found")
    )
    both = per_node.join(per_edge, "script_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    counts = (F.col("n_nodes") == n_nodes) & (F.col("n_edges") == n_edges)
    found_all = F.col("nodes_found") & F.coalesce("edges_found", F.lit(not need_edges))
    return both.select("script_id", "n_nodes", "n_edges", (counts & found_all).alias("correct"))
