"""Generated tables: the same for a seed on any partitioning, varied, and self-consistent."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from episodica.operators import catalog, generate
from episodica.session import prepare


def test_same_seed_same_task_on_any_partitioning(spark):
    prepare(spark)
    seeds = generate.seeds(spark, 200, base=3)
    assert seeds.agg(F.min("seed"), F.max("seed")).first()[:] == (30_000, 30_199)
    one, eight = generate.gen_tasks(seeds.coalesce(1)), generate.gen_tasks(seeds.repartition(8))
    assert one.exceptAll(eight).count() == eight.exceptAll(one).count() == 0


@pytest.mark.parametrize("template", ["auth_protocol", "binary_format"])
def test_hundred_seeds(spark, template):
    prepare(spark)
    seeds = generate.seeds(spark, 100)
    tasks = generate.gen_tasks(seeds, template).collect()
    skills = {r.skill_id: r for r in generate.gen_skills(seeds, template).collect()}
    assert len({t.task_id for t in tasks}) == 100 and len({t.description for t in tasks}) >= 10
    for task in tasks:
        assert (task.source, task.template, task.difficulty) == ("procedural", template, "easy")
        assert 4 <= len(task.distractors) == len(set(task.distractors)) <= 6
        assert set(task.distractors) <= set(generate.POOL)
        assert len(task.relevant) == 1 and len(skills[task.relevant[0]].full_content) > 100


def test_templates(spark):
    prepare(spark)
    seeds = generate.seeds(spark, 50)
    drawn = {r.template for r in generate.gen_tasks(seeds).select("template").distinct().collect()}
    assert drawn == {"auth_protocol", "binary_format"}
    with pytest.raises(ValueError, match="unknown template"):
        generate.gen_tasks(seeds, "other")


def test_auth_cases_match_a_plain_computation(spark):
    prepare(spark)
    rows = generate.auth_cases(generate.seeds(spark, 60)).collect()
    assert len(rows) == 180 and len({(r.algo, r.signing, r.header) for r in rows}) > 25
    for r in rows:
        text = {
            "key:timestamp": f"{r.api_key}:{r.ts}", "timestamp.key": f"{r.ts}.{r.api_key}",
            "key|timestamp|method": f"{r.api_key}|{r.ts}|{r.method}", "method:key:timestamp": f"{r.method}:{r.api_key}:{r.ts}",
        }[r.signing]
        sig = base64.b64encode(hmac.new(r.api_key.encode(), text.encode(), getattr(hashlib, r.algo)).digest()).decode()
        prefix = r.api_name[:3].upper()
        want = {
            f"X-{r.api_name}-Auth": f"{prefix} {r.api_key}:{sig}:{r.ts}", "Authorization": f"Bearer {sig}",
            f"X-{r.api_name}-Signature": f"{prefix} sig={sig},key={r.api_key},ts={r.ts}", f"X-{r.api_name}-Token": f"{prefix} {r.ts}:{sig}",
        }
        assert want[r.header_name] == r.header_value
        assert r.method == "GET" or "method" in r.signing


def test_binary_cases(spark):
    prepare(spark)
    rows = generate.binary_cases(generate.seeds(spark, 40)).collect()
    for r in rows:
        assert r.record_count == {1: 42 + r.seed % 100, 2: 1, 3: 1000 + r.seed}[r.case_id]
        assert len(r.data) == 16 and bytes(r.data[:4]).decode() == r.magic
        assert r.flag_values[0] == (r.case_id != 2)
    assert {r.endian for r in rows} == {"big", "little"}


def test_bank_checks(spark):
    prepare(spark)
    tasks = spark.createDataFrame(
        [("t1", ["a"], ["b", "c", "d", "e"]), ("t2", ["a"], ["a", "b", "c", "x"]), ("t3", ["a"], ["b"])],
        "task_id string, relevant array<string>, distractors array<string>",
    )
    skills = spark.createDataFrame([(c, c.upper(), "s") for c in "abcde"], "skill_id string, name string, short_description string")
    refs = catalog.references(tasks)
    sound = {r.task_id: (r.catalog_size, r.overlap, r.sound) for r in catalog.bank_integrity(refs).collect()}
    assert sound == {"t1": (5, 0, True), "t2": (5, 1, False), "t3": (2, 0, False)}
    assert [tuple(r) for r in catalog.missing_skills(refs, skills).collect()] == [("x", 1)]
    strict, lenient = catalog.assemble(refs, skills), catalog.assemble(refs, skills, strict=False)
    assert (strict.count(), strict.where("not found").count(), lenient.count()) == (12, 1, 11)
    first = refs.where("task_id = 't1'").orderBy("position").collect()
    assert [(r.skill_id, r.role) for r in first][:2] == [("a", "relevant"), ("b", "distractor")]


def test_seeded_order_is_a_permutation(spark):
    prepare(spark)
    ids = F.array(*map(F.lit, "abcdef"))
    rows = spark.range(300).select(catalog.shuffled(ids, F.col("id")).alias("o"), catalog.task_index(F.col("id"), 13).alias("n")).collect()
    assert all(sorted(r.o) == list("abcdef") for r in rows)
    assert len({tuple(r.o) for r in rows}) > 150 and {r.n for r in rows} == set(range(13))


def test_pool_skills_have_rows(spark):
    prepare(spark)
    rows = generate.pool_skills(spark).collect()
    assert [r.skill_id for r in rows] == generate.POOL and all(len(r.full_content) > 60 for r in rows)
    assert [r.seed for r in generate.seeds(spark, 3, 7).collect()] == [70_000, 70_001, 70_002]


def test_integrity_is_dealt_by_rows(spark):
    """A table of any size is grouped in partitions of bounded rows, with a hot task and a hot skill in it."""
    rows = [("hot", f"s{i % 700}", "relevant" if i % 1400 < 5 else "distractor") for i in range(4000)]
    rows += [("one", "s1", "relevant")] * 2000 + [("one", "s1", None), (None, None, "relevant"), (None, "s2", None)]
    rows += [(f"t{i // 5}", f"s{i}", "relevant" if i % 5 else "distractor") for i in range(4000)] + [("few", "a", "relevant"), ("few", "a", "distractor")]
    refs = spark.createDataFrame(rows, "task_id string, skill_id string, role string")
    out = catalog.bank_integrity(refs, task_rows=100)
    assert out.rdd.getNumPartitions() >= len(rows) // 100
    want = {}
    for task, skill, role in rows:
        want.setdefault(task, {}).setdefault(skill, []).append(role)
    got = {r.task_id: (r.catalog_size, r.overlap, r.sound) for r in out.collect()}
    assert len(got) == out.count() == len(want)
    for task, skills in want.items():
        size, both = sum(map(len, skills.values())), sum(len(set(roles) - {None}) > 1 for roles in skills.values())
        assert got[task] == (size, both, both == 0 and size >= 5)
