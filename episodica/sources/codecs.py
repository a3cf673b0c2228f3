"""JSON payloads of actions, observations, states and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.sources import schemas


def action_json() -> Column:
    """Action payload; null optional fields are left out."""
    return F.to_json(F.struct("action_type", "skill_id", "answer"))


def _texts() -> Column:
    return F.array().cast("array<string>")


def _no_entries() -> Column:
    return F.map_from_arrays(_texts(), _texts())


def with_observation(df: DataFrame, payload: str, name: str = "observation") -> DataFrame:
    """Add the parsed step result with a default per absent field; ``reward`` may stay null.

    An absent ``remaining_invocations`` is 0 here but 5 in a state payload. The payload is
    parsed once, into a column of its own.
    """
    df, parsed = df.withColumn("_parsed", F.from_json(payload, schemas.RESULT)), F.col("_parsed")
    seen = parsed["observation"]
    no_catalog = F.array().cast("array<struct<id:string,name:string,description:string>>")
    defaults = {
        "task_description": F.lit(""), "skill_catalog": no_catalog, "difficulty": F.lit("easy"),
        "loaded_skills": _texts(), "loaded_skill_contents": _no_entries(),
        "context_budget_used": F.lit(0), "context_budget_total": F.lit(5), "skill_content": None,
        "remaining_invocations": F.lit(0), "verification_result": None, "skills_invoked": _texts(),
        "messages": _texts(), "metadata": _no_entries(),
    }
    fields = [
        (seen[n] if d is None else F.coalesce(seen[n], d)).alias(n) for n, d in defaults.items()
    ]
    done = F.coalesce(parsed["done"], F.lit(False)).alias("done")
    return df.withColumn(name, F.struct(*fields, done, parsed["reward"].alias("reward"))).drop("_parsed")


def with_state(df: DataFrame, payload: str, name: str = "state") -> DataFrame:
    """Add the parsed state with a default per absent field; ``episode_id`` may stay null."""
    df, parsed = df.withColumn("_parsed", F.from_json(payload, schemas.STATE)), F.col("_parsed")
    defaults = {
        "episode_id": None, "step_count": F.lit(0), "task_id": F.lit(""), "loaded_skills": _texts(),
        "skills_ever_loaded": _texts(), "skills_invoked": _texts(), "difficulty": F.lit("easy"),
        "done": F.lit(False), "context_budget_total": F.lit(5), "remaining_invocations": F.lit(5),
    }
    fields = [(parsed[n] if d is None else F.coalesce(parsed[n], d)).alias(n) for n, d in defaults.items()]
    return df.withColumn(name, F.struct(*fields)).drop("_parsed")


def with_violations(df: DataFrame, payload: str, required: dict[str, str]) -> DataFrame:
    """Add ``violations``: required fields that are absent or not of the stated type.

    Each value is read as text and then as its type, so a wrong type differs from an absence.
    """
    df = df.withColumn("_parsed", F.from_json(payload, ", ".join(f"{n} STRING" for n in required)))
    as_text = F.col("_parsed")
    checks = []
    for name, kind in required.items():
        text = as_text[name]
        typed = text if kind == "string" else text.try_cast(kind)
        checks.append(
            F.when(text.isNull(), F.lit(f"{name}: missing"))
            .when(typed.isNull(), F.lit(f"{name}: not {kind}"))
        )
    return df.withColumn("violations", F.array_compact(F.array(*checks))).drop("_parsed")


GRAPH_NODE_FIELDS = "id STRING, text STRING, speaker STRING, type STRING"
GRAPH_EDGE_FIELDS = "`from` STRING, `to` STRING, text STRING"


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(script_id, part, line): one JSON object a row, nodes (part 0) and edges (part 1) of all graphs."""
    node = F.struct(F.col("node_id").alias("id"), "text", "speaker", "type")
    edge = F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "text")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return nodes.select("script_id", F.lit(0).alias("part"), json(node).alias("line")).unionByName(
        edges.select("script_id", F.lit(1).alias("part"), json(edge).alias("line"))
    )


def graph_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables back from (script_id, line); lines that hold neither are the frame of a document."""
    line = F.rtrim(F.col("line"), F.lit(","))
    nodes = lines.where(F.col("line").startswith('{"id":')).select("script_id", F.from_json(line, GRAPH_NODE_FIELDS).alias("g"))
    edges = lines.where(F.col("line").startswith('{"from":')).select("script_id", F.from_json(line, GRAPH_EDGE_FIELDS).alias("g"))
    return (
        nodes.select("script_id", "g.*").withColumnRenamed("id", "node_id"),
        edges.select("script_id", "g.*").withColumnsRenamed({"from": "from_id", "to": "to_id"}),
    )
