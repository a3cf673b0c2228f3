"""Queries that grade submissions: text rules, golden results, rollouts, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions.text import first_yaml, strip_fences
from episodica.operators import grading
from episodica.plans.registry import query
from episodica.sources.tables import table

# Sample text per rule, in the order of the rules.
SAMPLES = {
    "task_003": ["code HLX-NET-4001", "try! load(1)", 'x.with_context("a")', "retry_with_backoff(f)",
                 "helix.log.error(e)", "Ok(v)"],
    "task_005": ["SELECT temporal_avg(price)", "TEMPORAL_MAX (stock)",
                 "BETWEEN TIMESTAMP '2024-01-01'\nAND TIMESTAMP '2024-03-01'", "WINDOW TUMBLING(d)",
                 "GROUP BY product_id", "INTERVAL '1 day'"],
    "task_006": ["vault-sync rotate prepare\nvault-sync rotate activate\nvault-sync rotate verify\nvault-sync rotate commit",
                 "vault-sync rotate rollback", "--grace-period 300s", "--probe-endpoint u", "if ok; then",
                 "db/prod/password"],
    "task_007": ["pipeline order_analytics {", 'source kafka("order-events")', "filter(s in [completed, refunded])",
                 "window(tumbling=5m)", "group_by: [product_id]", "branch { a -> sink b }",
                 "error_handler { dead_letter(q) }", "count(*), SUM(amount)"],
    "task_009": ["TEMPORAL JOIN o", "AS OF TIMESTAMP x", "on a.id = b.id", "rotation_interval: 7d",
                 "grace_period: 1s", "type: http_probe", "slack:#ops", "SecretClient()", "@p.on_rotate"],
    "task_010": ["name: shadow", "- name: a\n- name: b\n- name: c\n- name: d\n- name: e",
                 "metrics_gate: p99_latency < 2", "metrics_gate: error_rate < 1", "traffic_pct: 100",
                 "pipeline deploy_monitor {", "source kafka(x)", "window(tumbling=1m)",
                 "branch { error_rate > 1 }", "arc deploy start", "flux deploy f"],
}
TASK_IDS = [*SAMPLES, "task_999"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(texts) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


def _sql_check(check: grading.Check) -> str:
    if check.kind == "contains":
        return f"contains(answer, {_quoted(check.pattern)})"
    if check.kind == "order":
        at = [f"strpos(answer, {_quoted(p)})" for p in check.pattern.split(" < ")]
        return "(" + " AND ".join([f"{at[0]} > 0"] + [f"{a} < {b}" for a, b in zip(at, at[1:])]) + ")"
    if check.kind == "count":
        return f"len(regexp_extract_all(answer, {_quoted(check.pattern)})) >= {check.least}"
    return f"regexp_matches(answer, {_quoted(check.pattern)}, {_quoted(check.flags or 'c')})"


def _sql_rules(rules) -> str:
    """CASE from task to the list of its rule results."""
    cases = []
    for task in dict.fromkeys(r.task_id for r in rules):
        tests = ["(" + " AND ".join(map(_sql_check, r.tests)) + ")" for r in rules if r.task_id == task]
        cases.append(f"WHEN '{task}' THEN [{', '.join(tests)}]")
    return f"CASE task_id {' '.join(cases)} END"


SUBMISSIONS = f"""
s0 AS (SELECT doc_id, n_chars, text, {_sql_list(TASK_IDS)}[doc_id % 7 + 1] AS task_id FROM documents),
s AS (SELECT doc_id, task_id, text || chr(10) || array_to_string([pieces[i] FOR i IN range(1, len(pieces) + 1)
        IF (n_chars + i) % 13 <> 0], chr(10)) AS answer
      FROM (SELECT *, CASE task_id {' '.join(f"WHEN '{t}' THEN {_sql_list(p)}" for t, p in SAMPLES.items())}
                      ELSE ['none'] END AS pieces FROM s0))"""


def _submissions(spark, folder):
    """Documents as answers: the whole text, then most of the sample texts of a task."""
    docs = table(spark, folder, "documents")
    task = F.element_at(F.array(*map(F.lit, TASK_IDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    pieces = F.array(F.lit("none"))
    for task_id, texts in SAMPLES.items():
        pieces = F.when(F.col("task_id") == task_id, F.array(*map(F.lit, texts))).otherwise(pieces)
    kept = F.filter(pieces, lambda p, i: (F.col("n_chars") + i + 1) % 13 != 0)
    return docs.withColumn("task_id", task).select(
        F.col("doc_id").alias("submission_id"), "task_id",
        F.concat("text", F.lit("\n"), F.array_join(kept, "\n")).alias("answer"),
    )


@query(
    "grade_structural",
    f"""WITH {SUBMISSIONS}, g AS (SELECT doc_id, task_id, {_sql_rules(grading.RULES)} AS checks FROM s)
        SELECT doc_id AS submission_id, task_id, coalesce(list_bool_and(checks), true) AS correct FROM g""",
)
def grade_structural(spark, folder):
    graded = grading.grade_structural(_submissions(spark, folder))
    return graded.select("submission_id", "task_id", "correct")


def _sql_parts() -> str:
    cases = []
    for task in dict.fromkeys(r.task_id for r in grading.RULES):
        parts = [str(r.part) for r in grading.RULES if r.task_id == task]
        cases.append(f"WHEN '{task}' THEN [{', '.join(parts)}]")
    return f"CASE task_id {' '.join(cases)} END"


@query(
    "grade_parts",
    f"""WITH {SUBMISSIONS}, g AS (SELECT doc_id, task_id, unnest({_sql_rules(grading.RULES)}) AS ok,
                                         unnest({_sql_parts()}) AS part FROM s)
        SELECT doc_id AS submission_id, task_id, CAST(part AS INTEGER) AS part,
               CAST(sum(ok::INTEGER) AS INTEGER) AS passed, CAST(count(*) AS INTEGER) AS rules, bool_and(ok) AS part_ok
        FROM g GROUP BY doc_id, task_id, part""",
)
def grade_parts(spark, folder):
    return grading.grade_parts(_submissions(spark, folder)).drop("answer")


@query(
    "grade_cases",
    """WITH cases AS (SELECT p_partkey, n, CASE n WHEN 1 THEN p_size % 2 ELSE p_size % 3 END AS expected
                      FROM part, (SELECT unnest([1, 2]) AS n)),
       l AS (SELECT *, row_number() OVER () AS submission FROM lineitem),
       r AS (SELECT submission, l_partkey, 1 AS n, CAST(l_quantity AS BIGINT) % 2 AS value, false AS failed FROM l
             UNION ALL SELECT submission, l_partkey, 2, CAST(l_quantity AS BIGINT) % 3, l_tax = 0 FROM l WHERE l_discount > 0),
       g AS (SELECT l.l_orderkey, l.l_partkey, l.submission,
                    (SELECT count(*) FROM cases c WHERE c.p_partkey = l.l_partkey) AS cases,
                    (SELECT count(*) FROM r JOIN cases c ON c.p_partkey = r.l_partkey AND c.n = r.n
                       WHERE r.submission = l.submission AND NOT failed
                         AND (r.value = c.expected OR c.p_partkey % 2 = 0 AND abs(r.value - c.expected) < 1.5)) AS passed FROM l)
       SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS task_id, cases, passed, cases = passed AS correct FROM g""",
)
def grade_cases(spark, folder):
    """Order lines as submissions with two results each; one is sometimes missing or failed. Every other part is tolerant."""
    part, key = table(spark, folder, "part"), F.col("p_partkey").cast("string")
    golden = F.array(
        F.struct(F.lit(1).alias("case_id"), (F.col("p_size") % 2).cast("string").alias("expected")),
        F.struct(F.lit(2).alias("case_id"), (F.col("p_size") % 3).cast("string").alias("expected")),
    )
    tolerance = F.when(F.col("p_partkey") % 2 == 0, 1.5).alias("tolerance")
    cases = part.select(key.alias("task_id"), tolerance, F.inline(golden))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = table(spark, folder, "lineitem").withColumn("submission_id", F.md5(F.concat_ws("|", *columns)))
    lines = lines.withColumn("task_id", F.col("l_partkey").cast("string"))
    amount = F.col("l_quantity").cast("long")
    error = F.when(F.col("l_tax") == 0, "failed")
    first = F.struct(F.lit(1).alias("case_id"), (amount % 2).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
    second = F.struct(F.lit(2).alias("case_id"), (amount % 3).cast("string").alias("value"), error.alias("error"))
    results = lines.select(
        "submission_id", "task_id", F.inline(F.when(F.col("l_discount") > 0, F.array(first, second)).otherwise(F.array(first)))
    )
    graded = grading.grade_cases(lines.select("submission_id", "task_id", "l_orderkey"), results, cases)
    return graded.select("l_orderkey", "task_id", "cases", "passed", "correct")


def _config():
    c = F.col("c_custkey")

    def phase(name, traffic, gate):
        return F.struct(
            (name if not isinstance(name, str) else F.lit(name)).alias("name"),
            (F.lit(traffic) if isinstance(traffic, int) else traffic).cast("int").alias("traffic_pct"),
            F.lit(5).alias("duration_min"), gate.cast("string").alias("metrics_gate"),
        )

    gate = F.lit("error_rate < 0.01")
    phases = F.array(
        phase(F.when(c % 5 == 0, "warmup").otherwise("shadow"), 0, gate),
        phase("canary_1", F.when(c % 11 == 0, 25).otherwise(5), gate),
        phase("canary_2", F.when(c % 11 == 0, 5).otherwise(25), F.when(c % 3 != 0, gate)),
        phase("canary_3", 50, gate),
        phase("full", 100, F.lit(None)),
    )
    rollback = F.when(c % 17 != 0, F.struct((c % 13 != 0).alias("auto"), F.lit("immediate").alias("on_metric_breach"),
                                            F.lit(30).alias("cooldown_min")))
    kept = F.when(c % 7 == 0, F.slice(phases, 1, 4)).otherwise(phases)
    return F.struct(F.struct(kept.alias("phases"), rollback.alias("rollback")).alias("canary"))


@query(
    "rollout_check",
    """SELECT c_custkey, array_to_string(list_filter([
         CASE WHEN c_custkey % 7 = 0 THEN 'phases' END, CASE WHEN c_custkey % 5 = 0 THEN 'first' END,
         CASE WHEN c_custkey % 7 = 0 THEN 'last' END, CASE WHEN c_custkey % 11 = 0 THEN 'order' END,
         CASE WHEN c_custkey % 3 = 0 THEN 'gate' END,
         CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'rollback' END], lambda x: x IS NOT NULL), ',') AS failures
       FROM customer""",
)
def rollout_check(spark, folder):
    """A rollout document per customer, broken in various ways."""
    rows = table(spark, folder, "customer").select("c_custkey", _config().alias("config"))
    return rows.select("c_custkey", F.array_join(grading.rollout_failures(F.col("config")), ",").alias("failures"))


ROLLOUT_TEXT = """
y AS (SELECT c_custkey, 'canary:' || chr(10) || '  phases:' || chr(10) || array_to_string([
        '    - name: ' || CASE WHEN c_custkey % 5 = 0 THEN 'warmup' ELSE 'shadow' END || chr(10) || '      traffic_pct: 0' || chr(10) || '      metrics_gate: error_rate < 0.01',
        '    - name: canary_1' || chr(10) || '      traffic_pct: 5' || chr(10) || '      metrics_gate: ' || CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'error_rate' END,
        '    - name: canary_2' || chr(10) || '      traffic_pct: 25', '    - name: canary_3' || chr(10) || '      traffic_pct: 50']
        || CASE WHEN c_custkey % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['    - name: full' || chr(10) || '      traffic_pct: 100'] END, chr(10))
        || chr(10) || '  rollback:' || chr(10) || '    auto: ' || CASE WHEN c_custkey % 13 = 0 THEN 'false' ELSE 'True' END AS answer,
      'task_004' AS task_id FROM customer)"""


def _rollout_texts(spark, folder):
    c = F.col("c_custkey")
    lines = F.array(
        F.lit("canary:"), F.lit("  phases:"),
        F.concat(F.lit("    - name: "), F.when(c % 5 == 0, "warmup").otherwise("shadow")),
        F.lit("      traffic_pct: 0"), F.lit("      metrics_gate: error_rate < 0.01"),
        F.lit("    - name: canary_1"), F.lit("      traffic_pct: 5"),
        F.concat(F.lit("      metrics_gate: "), F.when(c % 3 == 0, "none").otherwise("error_rate")),
        F.lit("    - name: canary_2"), F.lit("      traffic_pct: 25"),
        F.lit("    - name: canary_3"), F.lit("      traffic_pct: 50"),
        F.when(c % 7 != 0, "    - name: full"), F.when(c % 7 != 0, "      traffic_pct: 100"),
        F.lit("  rollback:"),
        F.concat(F.lit("    auto: "), F.when(c % 13 == 0, "false").otherwise("True")),
    )
    return table(spark, folder, "customer").select(
        "c_custkey", F.lit("task_004").alias("task_id"), F.array_join(F.array_compact(lines), "\n").alias("answer")
    )


@query(
    "rollout_check_text",
    f"""WITH {ROLLOUT_TEXT} SELECT c_custkey, list_bool_and({_sql_rules(grading.ROLLOUT_RULES)}) AS correct FROM y""",
)
def rollout_check_text(spark, folder):
    """The same kind of document as text inside a fenced block, checked by patterns."""
    texts = _rollout_texts(spark, folder)
    fenced = F.concat(F.lit("```yaml\n"), "answer", F.lit("\n```"))
    graded = grading.grade_structural(
        texts.withColumn("answer", first_yaml(fenced)), grading.ROLLOUT_RULES
    )
    return graded.select("c_custkey", "correct")


@query(
    "strip_fences",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || chr(10) WHEN 1 THEN text || chr(10) WHEN 2 THEN text
         ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS code,
         CASE WHEN turn % 4 = 1 THEN text || chr(10) WHEN turn % 4 = 0 THEN '```python' || chr(10) || text || chr(10) || '```'
              WHEN turn % 4 = 2 THEN '```js' || chr(10) || text || chr(10) || '```' ELSE '  ' || text || '  ' END AS yaml
       FROM conversations""",
)
def strip_fences_query(spark, folder):
    """Conversation texts as answers in a python block, a plain block, a foreign block, or bare."""
    kind = F.col("turn") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("```python\n"), "text", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here: ```\n"), "text", F.lit("\n``` as asked")))
        .when(kind == 2, F.concat(F.lit("```js\n"), "text", F.lit("\n```")))
        .otherwise(F.concat(F.lit("  "), "text", F.lit("  ")))
    )
    return table(spark, folder, "conversations").withColumn("answer", answer).select(
        "conv_id", "turn", strip_fences(F.col("answer")).alias("code"), first_yaml(F.col("answer")).alias("yaml")
    )
