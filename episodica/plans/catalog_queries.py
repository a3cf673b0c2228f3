"""Queries over banks and catalogs, their scans, seeded orders and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import catalog, generate
from episodica.plans.episode_queries import FOLD, TASKS, joined, states
from episodica.plans.registry import query
from episodica.plans.skew import ordered
from episodica.session import durable, fresh_dir
from episodica.sources import bindings, files
from episodica.sources.tables import table

REFS = """
refs AS (SELECT CAST(l_orderkey AS VARCHAR) AS task_id, CAST(l_partkey AS VARCHAR) AS skill_id,
                CASE WHEN l_returnflag = 'R' THEN 'relevant' ELSE 'distractor' END AS role, l_linenumber
         FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY role <> 'relevant', l_linenumber, skill_id)
           AS position FROM refs),
skills AS (SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS name,
                  p_brand || ' ' || p_type AS short_description FROM part WHERE p_size < 48)"""


def _placed(spark, folder):
    return catalog.placed(bindings.bank_references(spark, folder), ["l_linenumber", "skill_id"])


@query(
    "scan_skills",
    """SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS name, p_brand || ' ' || p_type AS short_description,
       CAST(length(p_name || chr(10) || p_brand || chr(10) || p_type) AS INTEGER) AS head_length, false AS seeded
       FROM part WHERE p_size < 48""",
)
def scan_skills(spark, folder):
    """Bank of skills written as JSON lines and read back with its schema."""
    path = fresh_dir(spark, "skills")
    bindings.bank_skills(spark, folder).write.json(path)
    head = F.substring_index("full_content", "\n", 3)
    return files.read_skills(spark, path, "json").select(
        "skill_id", "name", "short_description", F.length(head).alias("head_length"), F.col("seed").isNotNull().alias("seeded"),
    )


@query(
    "scan_tasks",
    f"""WITH {TASKS} SELECT task_id, difficulty, source, array_to_string(relevant, ',') AS relevant,
        CAST(8 - len(relevant) AS INTEGER) AS n_distractors, CAST(NULL AS VARCHAR) AS template FROM t""",
)
def scan_tasks(spark, folder):
    """Task bank with nested id lists, written and read back; absent keys are null."""
    path = fresh_dir(spark, "tasks")
    bindings.tasks(spark, folder).write.parquet(path)
    return files.read_tasks(spark, path).select(
        "task_id", "difficulty", "source", joined("relevant").alias("relevant"),
        F.size("distractors").alias("n_distractors"), "template",
    )


@query("catalog_projection", f"WITH {REFS} SELECT skill_id AS id, name, short_description AS description FROM skills")
def catalog_projection(spark, folder):
    return bindings.bank_skills(spark, folder).select(catalog.catalog_entry().alias("e")).select("e.*")


@query(
    "catalog_assembly",
    f"""WITH {REFS} SELECT task_id, position, skill_id, role, name, short_description,
        skills.skill_id IS NOT NULL AS found FROM placed LEFT JOIN skills USING (skill_id)""",
)
def catalog_assembly(spark, folder):
    out = catalog.assemble(_placed(spark, folder), bindings.bank_skills(spark, folder))
    return out.select("task_id", "position", "skill_id", "role", "name", "short_description", "found")


@query(
    "catalog_assembly_lenient",
    f"WITH {REFS} SELECT task_id, position, skill_id, name FROM placed JOIN skills USING (skill_id)",
)
def catalog_assembly_lenient(spark, folder):
    out = catalog.assemble(_placed(spark, folder), bindings.bank_skills(spark, folder), strict=False)
    return out.select("task_id", "position", "skill_id", "name")


@query(
    "integrity_missing",
    f"""WITH {REFS} SELECT skill_id, count(*) AS "references" FROM refs
        WHERE skill_id NOT IN (SELECT skill_id FROM skills) GROUP BY skill_id""",
)
def integrity_missing(spark, folder):
    return catalog.missing_skills(bindings.bank_references(spark, folder), bindings.bank_skills(spark, folder))


@query(
    "integrity_bank",
    f"""WITH {REFS}, s AS (SELECT task_id, skill_id, count(*) AS n, count(DISTINCT role) AS roles FROM refs GROUP BY ALL)
        SELECT task_id, CAST(sum(n) AS BIGINT) AS catalog_size,
               CAST(sum(CASE WHEN roles > 1 THEN 1 ELSE 0 END) AS BIGINT) AS overlap,
               sum(CASE WHEN roles > 1 THEN 1 ELSE 0 END) = 0 AND sum(n) >= 5 AS sound FROM s GROUP BY task_id""",
)
def integrity_bank(spark, folder):
    return catalog.bank_integrity(bindings.bank_references(spark, folder))


@query(
    "bank_union",
    f"""WITH {TASKS} SELECT source, template, count(*) AS tasks FROM (
          SELECT source, NULL AS template FROM t UNION ALL SELECT 'generated', 'auth_protocol' FROM customer)
        GROUP BY source, template""",
)
def bank_union(spark, folder):
    """Bank tasks and generated tasks in one table; absent columns become null."""
    seeds = table(spark, folder, "customer").select(F.col("c_custkey").alias("seed"))
    made = generate.auth_tasks(seeds).withColumn("source", F.lit("generated"))
    both = bindings.tasks(spark, folder).unionByName(made, allowMissingColumns=True)
    return both.groupBy("source", "template").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "loaded_contents",
    FOLD
    + """SELECT episode_id, array_to_string([x || '=Content of ' || x FOR x IN loaded IF x <> 's7'], ';') AS contents,
         CAST(len([x FOR x IN loaded IF x <> 's7']) AS INTEGER) AS n FROM state""",
)
def loaded_contents(spark, folder):
    """Contents of the loaded skills; ids the skill table lacks are left out."""
    known = bindings.skills(spark, folder).where("skill_id <> 's7'")
    out = catalog.contents_of(durable(states(spark, folder).select("episode_id", "loaded")), known)
    pairs = F.map_entries("loaded_skill_contents")
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(
        "episode_id",
        F.coalesce(text, F.lit("")).alias("contents"),
        F.coalesce(F.size(F.map_keys("loaded_skill_contents")), F.lit(0)).alias("n"),
    )


@query(
    "catalog_shuffle",
    """SELECT c_custkey, array_to_string([r[2] FOR r IN list_sort([[md5(c_custkey || ':' || i), i]
         FOR i IN ['s0', 's1', 's2', 's3', 's4', 's5', 's6', 's7']])], ',') AS catalog FROM customer""",
)
def catalog_shuffle(spark, folder):
    ids = F.array(*map(F.lit, bindings.CATALOG))
    return table(spark, folder, "customer").select(
        "c_custkey", joined(catalog.shuffled(ids, F.col("c_custkey"))).alias("catalog")
    )


@query(
    "task_sample",
    f"""WITH {TASKS}, n AS (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS task_no FROM t),
          c AS (SELECT c_custkey, ('0x' || substr(md5('task:' || c_custkey), 1, 8))::BIGINT % (SELECT count(*) FROM t) AS task_no FROM customer)
        SELECT c_custkey, task_no, task_id, difficulty FROM c JOIN n USING (task_no)""",
)
def task_sample(spark, folder):
    """Each customer as a seed that picks a task row, whatever the size of the bank."""
    bank = bindings.tasks(spark, folder).select("task_id", "difficulty")
    bank = ordered(bank.withColumn("_bank", F.lit(1)), ["_bank"], ["task_id"], number="place").drop("_bank")
    drawn = catalog.task_index(F.col("c_custkey"), bank.count()).alias("task_no")
    picked = table(spark, folder, "customer").select("c_custkey", drawn)
    return picked.join(bank.withColumn("task_no", F.col("place") - 1).drop("place"), "task_no").select("c_custkey", "task_no", "task_id", "difficulty")


@query(
    "distractor_sample",
    """SELECT c_custkey, array_to_string([r[2] FOR r IN list_sort([[md5('distractors:' || c_custkey || ':' || i), i]
         FOR i IN ['skill_proc_dist_001', 'skill_proc_dist_002', 'skill_proc_dist_003', 'skill_proc_dist_004',
                   'skill_proc_dist_005', 'skill_proc_dist_006', 'skill_proc_dist_007', 'skill_proc_dist_008']])]
         [1:4 + ('0x' || substr(md5('n_distractors:' || c_custkey), 1, 8))::BIGINT % 3], ',') AS distractors
       FROM customer""",
)
def distractor_sample(spark, folder):
    seed = F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", joined(generate.distractors(seed)).alias("distractors"))
