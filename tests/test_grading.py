"""Text rules, fences, golden results, rollouts and graphs: passes and stuffed failures."""

import pytest
from pyspark.sql import functions as F

from episodica.functions.text import first_yaml, strip_fences
from episodica.operators import grading
from episodica.plans.grading_queries import SAMPLES
from episodica.session import prepare

GOOD = {task: "\n".join(texts) for task, texts in SAMPLES.items()}
STUFFED = {
    "task_003": "HLX-DATA try! with_context retry backoff helix.log.error result Ok Err",
    "task_005": "TEMPORAL_AVG TEMPORAL_MAX BETWEEN 2024-01-01 2024-03-01 WINDOW TUMBLING GROUP BY product_id",
    "task_006": "prepare activate verify commit rollback grace-period probe-endpoint db/prod/password",
    "task_007": "pipeline order_analytics kafka order-events filter completed refunded tumbling 5m count sum",
    "task_009": "temporal join as of rotation_interval grace_period http_probe slack SecretClient",
    "task_010": "shadow metrics_gate latency error_rate traffic_pct deploy_monitor kafka branch arc flux",
}


def grade(spark, pairs, rules=grading.RULES, **more):
    prepare(spark)
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(pairs)], "i int, task_id string, answer string")
    return [r.correct for r in grading.grade_structural(df, rules, **more).orderBy("i").collect()]


def test_text_rules(spark):
    assert len(grading.RULES) == 46 and len(grading.ROLLOUT_RULES) == 6
    assert all(grade(spark, GOOD.items()))
    assert not any(grade(spark, STUFFED.items()))
    assert not any(grade(spark, [(t, None) for t in GOOD]))
    assert grade(spark, [("no_rules", "x"), ("no_rules", None)]) == [True, True]


@pytest.mark.parametrize("task", sorted(SAMPLES))
def test_every_rule_counts(spark, task):
    """Leaving out any one sample text breaks the task."""
    texts = SAMPLES[task]
    answers = [(task, "\n".join(t for j, t in enumerate(texts) if j != i)) for i in range(len(texts))]
    assert not any(grade(spark, answers))


def test_order_of_commands(spark):
    steps = ["prepare", "activate", "verify", "commit"]
    rest = "\n".join(SAMPLES["task_006"][1:])
    answer = lambda order: "\n".join(f"vault-sync rotate {s}" for s in order) + "\n" + rest
    got = grade(spark, [("task_006", answer(steps)), ("task_006", answer(steps[::-1])), ("task_006", answer(steps[:3]))])
    assert got == [True, False, False]


def test_unicode_classes_and_line_ends(spark):
    """Word characters and boundaries are Unicode; a dot stops at a line feed only."""
    rules = [
        grading.Rule("w", 1, (grading.Check("regex", r"try!\s*\w+"),)),
        grading.Rule("d", 1, (grading.Check("regex", "a.b"),)),
    ]
    got = grade(spark, [("w", "try! été"), ("d", "a b"), ("d", "a\rb"), ("d", "a\nb")], rules)
    assert got == [True, True, True, False]


def test_hook_for_own_checks(spark):
    hook = {"mine": lambda text: F.length(text) > 3}
    assert grade(spark, [("mine", "long"), ("mine", "no"), ("mine", None), ("other", "no")], hooks=hook) == [True, False, False, True]


def test_parts(spark):
    prepare(spark)
    answer = "\n".join(SAMPLES["task_009"][:7])
    df = spark.createDataFrame([(1, "task_009", answer)], "submission_id int, task_id string, answer string")
    rows = grading.grade_parts(df).orderBy("part").collect()
    assert [(r.part, r.passed, r.rules, r.part_ok) for r in rows] == [(1, 3, 3, True), (2, 4, 4, True), (3, 0, 2, False)]


@pytest.mark.parametrize(
    "answer, code",
    [
        ("```python\nx = 1\n```", "x = 1\n"), ("text ```\na\nb\n``` more ```\nc\n```", "a\nb\n"),
        ("```js\na\n```", "a"), ("  bare \n", "bare"), ("```", ""), ("", ""), ("```python\nopen", "open"),
        ("```python   \n\nx```", "x"), ("a ``` b", "a ``` b"),
    ],
)
def test_fences(spark, answer, code):
    """Checked against the same rule written with the standard regular expressions."""
    import re

    text = answer.strip()
    block = re.search(r"```(?:python)?\s*\n(.*?)```", text, re.DOTALL)
    if block:
        expected = block.group(1)
    elif text.startswith("```"):
        expected = "\n".join(line for line in text.split("\n") if not line.strip().startswith("```"))
    else:
        expected = text
    assert expected == code
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(strip_fences(F.col("a"))).first()[0] == code


def test_yaml_block(spark):
    df = spark.createDataFrame([("x ```yaml\na: 1\n``` y",), ("```\nb\n```",), ("plain",), ("```json\n{}```",)], "a string").coalesce(1)
    assert [r[0] for r in df.select(first_yaml(F.col("a"))).collect()] == ["a: 1\n", "b\n", "plain", "```json\n{}```"]


PHASES = [("shadow", 0, 5, "g"), ("canary_1", 5, 10, "g"), ("canary_2", 25, 15, "g"), ("canary_3", 50, 20, "g"), ("full", 100, 0, None)]


@pytest.mark.parametrize(
    "phases, auto, broken",
    [
        (PHASES, True, []), (PHASES[:4], True, ["phases", "last"]), ([("warm", *PHASES[0][1:]), *PHASES[1:]], True, ["first"]),
        ([*PHASES[:4], ("full", 90, 0, "g")], True, ["last"]), ([PHASES[0], PHASES[2], PHASES[1], *PHASES[3:]], True, ["order"]),
        ([*PHASES[:3], ("canary_3", 50, 20, None), PHASES[4]], True, ["gate"]), (PHASES, False, ["rollback"]),
        ([*PHASES[:1], ("x", None, 1, "g"), *PHASES[2:]], True, []), ([], True, ["phases", "first", "last"]),
    ],
)
def test_rollout(spark, phases, auto, broken):
    from episodica.sources.schemas import ROLLOUT

    prepare(spark)
    df = spark.createDataFrame([(((phases, (auto, "now", 30)),),)], f"config STRUCT<{ROLLOUT.replace('canary STRUCT', 'canary: STRUCT', 1)}>")
    assert df.select(grading.rollout_failures(F.col("config"))).first()[0] == broken


def test_golden_cases(spark):
    prepare(spark)
    cases = spark.createDataFrame(
        [("t", 1, '"a"', None), ("t", 2, "0.62487", 0.01), ("u", 1, "1", None)],
        "task_id string, case_id int, expected string, tolerance double",
    )
    subs = spark.createDataFrame([(i, "t") for i in range(6)] + [(6, "none")], "submission_id int, task_id string")
    results = spark.createDataFrame(
        [
            (0, "t", 1, '"a"', None), (0, "t", 2, "0.63", None),  # passes within tolerance
            (1, "t", 1, '"a"', None), (1, "t", 2, "0.7", None),  # too far
            (2, "t", 1, '"a"', None),  # missing result
            (3, "t", 1, '"a"', None), (3, "t", 2, "0.62487", "boom"),  # raised an error
            (4, "t", 1, None, None), (4, "t", 2, "0.62487", None),  # null result
        ],
        "submission_id int, task_id string, case_id int, value string, error string",
    )
    rows = grading.grade_cases(subs, results, cases).orderBy("submission_id").collect()
    assert [r.correct for r in rows] == [True, False, False, False, False, False, True]
    hooks = {"t": lambda value, expected: value.isNotNull()}
    rows = grading.grade_cases(subs, results, cases, hooks).orderBy("submission_id").collect()
    assert [r.correct for r in rows] == [True, True, False, False, False, False, True]
