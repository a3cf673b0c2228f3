"""Dialogue scripts as node and edge tables.

A script may come as one text per row or as one line per row; the rules need lines.
``[Name]`` opens a scene. A scene with a numbered line is a choice, else a line scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.text import DIALECT, strip
from episodica.plans.skew import HOT_ROWS, keyed_join, ordered

# The line forms of a script.
HEADER = DIALECT + r"^\[(\w+)\]$"
NUMBERED = DIALECT + r"^\d+\."
OPTION = DIALECT + r"^(\d+\.\s*.+?)\s*->\s*(\w+)$"
SPOKEN = DIALECT + r"^(\w[\w\s]*):\s*(.+)$"
SPOKEN_TO = DIALECT + r"^(\w[\w\s]*):\s*(.+?)\s*->\s*(\w+)$"


def lines_of(scripts: DataFrame) -> DataFrame:
    """(script_id, line_no, line) from (script_id, text); blank lines are skipped."""
    rows = scripts.select("script_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", strip(F.col("line"))).where("line <> ''")


def scene_lines(lines: DataFrame, order: list[str], slice_rows: int = HOT_ROWS) -> DataFrame:
    """Each line with the scene it belongs to: the last header at or above it.

    ``scene_at`` is the place of that header, so a name used twice stays two scenes.
    Lines above the first header belong to none and are dropped.
    """
    header = F.col("line").rlike(HEADER)
    at = F.struct(*order)
    scene = F.struct(F.regexp_extract("line", HEADER, 1).alias("id"), at.alias("at"))
    lines = lines.withColumn("is_header", header)
    carried = ordered(
        lines, ["script_id"], order, carry={"scene": F.when(header, scene)}, slice_rows=slice_rows
    )
    return carried.where(F.col("scene").isNotNull()).select(
        *lines.columns, F.col("scene.id").alias("scene_id"), F.col("scene.at").alias("scene_at")
    )


def _extract(pattern: str, group: int) -> Column:
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group))


def dialogue_nodes(scenes: DataFrame, order: list[str]) -> DataFrame:
    """One node per scene. The last spoken line gives speaker and text; choices have none."""
    at = F.struct(*order)
    body = ~F.col("is_header")
    speaker = F.coalesce(_extract(SPOKEN_TO, 1), _extract(SPOKEN, 1))
    text = strip(F.coalesce(_extract(SPOKEN_TO, 2), _extract(SPOKEN, 2)))
    spoken = body & speaker.isNotNull()
    choice = F.bool_or(body & F.col("line").rlike(NUMBERED))
    grouped = scenes.groupBy("script_id", "scene_at").agg(
        F.first("scene_id").alias("node_id"),
        choice.alias("choice"),
        F.max_by(F.struct(speaker.alias("speaker"), text.alias("text")), F.when(spoken, at)).alias("said"),
    )

    def unless_choice(name: str) -> Column:
        return F.when(F.col("choice"), "").otherwise(F.coalesce(f"said.{name}", F.lit("")))

    return grouped.select(
        "script_id", "scene_at", "node_id", unless_choice("text").alias("text"),
        unless_choice("speaker").alias("speaker"),
        F.when(F.col("choice"), "choice").otherwise("line").alias("type"),
    )


def dialogue_edges(scenes: DataFrame, order: list[str]) -> DataFrame:
    """Edges: one per option of a choice; for a line scene the last line with an arrow."""
    body = scenes.where(~F.col("is_header"))
    options = body.where(F.col("line").rlike(OPTION)).select(
        "script_id", F.col("scene_id").alias("from_id"), _extract(OPTION, 2).alias("to_id"),
        strip(_extract(OPTION, 1)).alias("text"),
    )
    target = _extract(SPOKEN_TO, 3)
    moves = (
        body.groupBy("script_id", "scene_at")
        .agg(
            F.first("scene_id").alias("from_id"),
            F.bool_or(F.col("line").rlike(NUMBERED)).alias("choice"),
            F.max_by(target, F.when(target.isNotNull(), F.struct(*order))).alias("to_id"),
        )
        .where(~F.col("choice") & F.col("to_id").isNotNull())
        .select("script_id", "from_id", "to_id", F.lit("").alias("text"))
    )
    return options.unionByName(moves)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a node that does not exist, each reported once."""
    known = nodes.select("script_id", F.col("node_id").alias("to_id")).distinct()
    lost = keyed_join(edges, known, ["script_id", "to_id"], "left_anti")
    message = F.format_string("Edge '%s'->'%s' points to missing node '%s'", "from_id", "to_id", "to_id")
    return lost.select("script_id", "from_id", "to_id").distinct().withColumn("message", message)
