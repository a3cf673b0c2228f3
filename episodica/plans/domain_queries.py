"""Queries over levels, series, dialogue scripts and versioned rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import dialogue, grading, hpfilter, levels, temporal
from episodica.plans.registry import query
from episodica.plans.skew import keyed_join
from episodica.session import durable, fresh_dir
from episodica.sources import bindings, files
from episodica.sources.tables import table


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


LEVELS = """
d AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS station_id, CAST(ts AS DATE) AS day, max(value) AS level,
             avg(value) AS mean_level, min(value) AS low_level FROM events GROUP BY ALL),
th AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 8, '0') AS station_id, (40 + user_id % 40)::DOUBLE AS flood FROM events)"""


def _daily(spark, folder):
    return levels.daily_levels(bindings.levels(spark, folder))


@query(
    "daily_levels",
    f"""WITH {LEVELS} SELECT station_id, CAST(day AS VARCHAR) AS day, level, round(mean_level, 6) AS mean_level, low_level FROM d""",
)
def daily_levels(spark, folder):
    return _daily(spark, folder).withColumns(
        {"day": F.col("day").cast("string"), "mean_level": F.round("mean_level", 6)}
    )


FLOODS = f"""WITH {LEVELS} SELECT station_id, count(*) AS flood_days FROM d JOIN th USING (station_id)
             WHERE level >= flood GROUP BY station_id"""


@query("flood_days", FLOODS)
def flood_days(spark, folder):
    return levels.flood_days(_daily(spark, folder), bindings.thresholds(spark, folder))


@query("flood_ranking", FLOODS + " ORDER BY flood_days DESC, station_id")
def flood_ranking(spark, folder):
    return levels.ranked(levels.flood_days(_daily(spark, folder), bindings.thresholds(spark, folder)))


@query("flood_report", FLOODS + " ORDER BY flood_days DESC, station_id")
def flood_report(spark, folder):
    return levels.flood_report(bindings.levels(spark, folder), bindings.thresholds(spark, folder))


@query(
    "flood_dates",
    f"""WITH {LEVELS} SELECT station_id, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS dates
        FROM d JOIN th USING (station_id) WHERE level >= flood GROUP BY station_id""",
)
def flood_dates(spark, folder):
    out = levels.flood_dates(_daily(spark, folder), bindings.thresholds(spark, folder))
    text = F.transform("dates", lambda d: d.cast("string"))
    return out.withColumn("dates", F.array_join(text, ","))


@query(
    "flood_severity",
    f"""WITH {LEVELS} SELECT station_id, CAST(day AS VARCHAR) AS day, CASE WHEN level >= flood + 300 THEN 'major'
          WHEN level >= flood + 150 THEN 'moderate' WHEN level >= flood THEN 'minor'
          WHEN level >= flood - 10 THEN 'action' ELSE 'normal' END AS severity FROM d JOIN th USING (station_id)""",
)
def flood_severity(spark, folder):
    out = levels.flood_severity(_daily(spark, folder), bindings.thresholds(spark, folder))
    return out.select("station_id", F.col("day").cast("string").alias("day"), "severity")


@query(
    "gauge_scan",
    """SELECT event_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS station_id, value AS level FROM events
       WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""",
)
def gauge_scan(spark, folder):
    """Readings of the stations that have a major stage, for one parameter code and a two-week range."""
    sites = bindings.thresholds(spark, folder).where("major is not null")
    rows = files.gauge_rows(bindings.levels(spark, folder), sites, "2024-01-08", "2024-01-22", "view")
    return rows.select("event_id", "station_id", "level")


@query(
    "thresholds_clean",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS station_id, c_acctbal AS flood,
         CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal + 10 END AS moderate,
         CASE WHEN c_nationkey % 3 <> 0 THEN c_acctbal + 20 END AS major FROM customer WHERE c_acctbal >= 0""",
)
def thresholds_clean(spark, folder):
    """Customers written as a threshold report with sentinels and junk, then read back clean."""
    path = fresh_dir(spark, "thresholds")
    level, nation = F.col("c_acctbal"), F.col("c_nationkey")
    report = table(spark, folder, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("usgs id"),
        F.when(level >= 0, level).otherwise(-9999.0).cast("string").alias("flood stage"),
        F.when(nation % 2 == 0, (level + 10).cast("string")).otherwise("n/a").alias("moderate flood stage"),
        F.when(nation % 3 != 0, (level + 20).cast("string")).otherwise("-9999").alias("major flood stage"),
    )
    report.write.option("header", True).csv(path)
    return files.read_thresholds(spark, path)


@query(
    "consecutive_failures",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                   - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events)
       SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS failures FROM n
       WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 3""",
)
def consecutive_failures(spark, folder):
    runs = levels.consecutive_failures(
        table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"),
        ["user_id"], ["ts", "event_id"], F.col("event_type") == "error",
    )
    return runs.select(
        "user_id", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "failures"
    )


@query(
    "rate_limit_flag",
    """SELECT event_id, event_type, count(*) OVER w AS in_span, count(*) OVER w > 5 AS limited
       FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
       WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""",
)
def rate_limit_flag(spark, folder):
    """More than 5 events of a type within an hour."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return levels.rate_limit_flag(rows, "event_type", "ts", limit=5, seconds=3600).drop("ts")


# --- series ---------------------------------------------------------------------------

SERIES = """
s AS (SELECT o_orderpriority AS series_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""


def _sql_filter(value: str, lamb: str) -> str:
    """The same five-band elimination as two recursions over each series."""
    lamb = f"{lamb}::DOUBLE"
    return f"""
WITH RECURSIVE {SERIES},
m AS (SELECT series_id, t, value, {value} AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n
      FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)),
b AS (SELECT *, 1 + {lamb} * ((i <= n - 2)::INTEGER + 4 * (i >= 2 AND i <= n - 1)::INTEGER + (i >= 3)::INTEGER) AS main,
             -2 * {lamb} * ((i <= n - 2)::INTEGER + (i >= 2 AND i <= n - 1)::INTEGER) AS near,
             {lamb} * (i <= n - 2)::INTEGER AS far FROM m),
f AS (SELECT series_id, i, main AS p1, 0.0::DOUBLE AS p2, near / main AS f1, far / main AS s1, 0.0::DOUBLE AS s2,
             y AS z1, 0.0::DOUBLE AS z2 FROM b WHERE i = 1
      UNION ALL
      SELECT series_id, i, p0, p1, (near - f1 * s1 * p1) / p0, far / p0, s1, z, z1
      FROM (SELECT f.series_id, b.i, f.p1, f.f1, f.s1, f.z1, b.near, b.far,
                   b.main - f.f1 * f.f1 * f.p1 - f.s2 * f.s2 * f.p2 AS p0, b.y - f.f1 * f.z1 - f.s2 * f.z2 AS z
            FROM f JOIN b ON b.series_id = f.series_id AND b.i = f.i + 1)),
x AS (SELECT f.series_id, f.i, z1 / p1 AS x1, 0.0::DOUBLE AS x2 FROM f JOIN b USING (series_id, i) WHERE i = n
      UNION ALL
      SELECT f.series_id, f.i, f.z1 / f.p1 - f.f1 * x.x1 - f.s1 * x.x2, x.x1
      FROM x JOIN f ON f.series_id = x.series_id AND f.i = x.i - 1),
h AS (SELECT m.series_id, m.t, m.value, x.x1 AS trend, m.y - x.x1 AS cycle FROM m JOIN x USING (series_id, i))
"""


@query(
    "hp_filter",
    _sql_filter("value", "14400") + "SELECT series_id, t, value, round(trend, 2) AS trend, round(cycle, 2) AS cycle FROM h",
)
def hp_filter(spark, folder):
    out = hpfilter.hp_filter(bindings.priority_series(spark, folder), float(hpfilter.LAMBDA["monthly"]))
    return out.withColumns({c: F.round(c, 2) for c in ("trend", "cycle")})


@query(
    "hp_correlation",
    _sql_filter("ln(value)", "14400")
    + """SELECT a.series_id AS series_a, b.series_id AS series_b, round(corr(a.cycle, b.cycle), 5) AS correlation,
           count(*) AS points FROM h a JOIN h b ON a.t = b.t
             AND CAST(left(a.series_id, 1) AS INTEGER) + 1 = CAST(left(b.series_id, 1) AS INTEGER) GROUP BY ALL""",
)
def hp_correlation(spark, folder):
    """Cycle of every priority against that of the next lower one."""
    series = durable(bindings.priority_series(spark, folder))
    rank = F.left("series_id", F.lit(1)).cast("int")
    ids = series.select("series_id", rank.alias("rank")).distinct()
    pairs = ids.select(F.col("series_id").alias("series_a"), (F.col("rank") + 1).alias("rank")).join(
        ids.select(F.col("series_id").alias("series_b"), "rank"), "rank"
    ).drop("rank")
    return hpfilter.cycle_correlation(series, pairs, hpfilter.lambda_of(F.lit("monthly")))


@query(
    "second_difference",
    f"""WITH {SERIES}, n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM s
                             WINDOW w AS (PARTITION BY series_id ORDER BY t))
        SELECT series_id, t, value, round(a - 2 * value + b, 2) AS second_difference FROM n
        WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def second_difference(spark, folder):
    out = hpfilter.second_difference(bindings.priority_series(spark, folder))
    return out.withColumn("second_difference", F.round("second_difference", 2))


# --- dialogue -------------------------------------------------------------------------

ORDER = ["turn", "pos"]

SCRIPTS = """
p AS (SELECT conv_id AS script_id, turn, role, unnest(list_transform(string_split(text, chr(10)),
        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM conversations),
q AS (SELECT * FROM p WHERE said <> ''),
nodes AS (SELECT c.conv_id AS script_id, 'T' || c.turn AS node_id,
            CASE WHEN c.role = 'user' THEN '' ELSE coalesce(l.said, '') END AS text,
            CASE WHEN c.role = 'user' OR l.said IS NULL THEN '' ELSE c.role END AS speaker,
            CASE WHEN c.role = 'user' AND l.said IS NOT NULL THEN 'choice' ELSE 'line' END AS type
          FROM conversations c LEFT JOIN (SELECT script_id, turn, arg_max(said, pos) AS said FROM q GROUP BY ALL) l
            ON l.script_id = c.conv_id AND l.turn = c.turn),
edges AS (SELECT script_id, 'T' || turn AS from_id, 'T' || (turn + 1) AS to_id, pos || '. ' || said AS text FROM q WHERE role = 'user'
          UNION ALL SELECT DISTINCT script_id, 'T' || turn, 'T' || (turn + 1), '' FROM q WHERE role = 'assistant')"""


def _scenes(spark, folder):
    return dialogue.scene_lines(bindings.script_lines(spark, folder), ORDER)


def _graph(spark, folder):
    """Nodes and edges; both read the scene lines, which are worked out once."""
    scenes = durable(_scenes(spark, folder))
    return dialogue.dialogue_nodes(scenes, ORDER), dialogue.dialogue_edges(scenes, ORDER)


@query(
    "dialogue_lines",
    f"""WITH {SCRIPTS} SELECT script_id, 'T' || turn AS scene_id,
          CASE role WHEN 'user' THEN pos || '. ' || said || ' -> T' || (turn + 1)
            WHEN 'assistant' THEN role || ': ' || said || ' -> T' || (turn + 1) ELSE role || ': ' || said END AS line
        FROM q UNION ALL SELECT conv_id, 'T' || turn, '[T' || turn || ']' FROM conversations""",
)
def dialogue_lines(spark, folder):
    return _scenes(spark, folder).select("script_id", "scene_id", "line")


@query("dialogue_nodes", f"WITH {SCRIPTS} SELECT * FROM nodes")
def dialogue_nodes(spark, folder):
    return dialogue.dialogue_nodes(_scenes(spark, folder), ORDER).drop("scene_at")


@query("dialogue_edges", f"WITH {SCRIPTS} SELECT * FROM edges")
def dialogue_edges(spark, folder):
    return _graph(spark, folder)[1]


@query(
    "graph_dangling",
    f"""WITH {SCRIPTS} SELECT DISTINCT script_id, 'Edge ''' || from_id || '''->''' || to_id || ''' points to missing node ''' || to_id || '''' AS message
        FROM edges WHERE (script_id, to_id) NOT IN (SELECT (script_id, node_id) FROM nodes)""",
)
def graph_dangling(spark, folder):
    return dialogue.dangling_edges(*_graph(spark, folder)).select("script_id", "message")


@query(
    "graph_json_roundtrip",
    f"""WITH {SCRIPTS} SELECT script_id, 'node' AS kind, node_id AS name, type AS target, text FROM nodes
        UNION ALL SELECT script_id, 'edge', from_id, to_id, text FROM edges""",
)
def graph_json_roundtrip(spark, folder):
    """One JSON file a graph, written and read back."""
    nodes, edges = _graph(spark, folder)
    place = fresh_dir(spark, "graphs")
    files.write_graphs(nodes, edges, place).write.format("noop").mode("overwrite").save()
    nodes, edges = files.read_graphs(spark, place, dict(nodes.dtypes)["script_id"])
    return nodes.select(
        "script_id", F.lit("node").alias("kind"), F.col("node_id").alias("name"), F.col("type").alias("target"), "text"
    ).unionByName(
        edges.select("script_id", F.lit("edge").alias("kind"), F.col("from_id").alias("name"), F.col("to_id").alias("target"), "text")
    )


@query(
    "grade_graph",
    f"""WITH {SCRIPTS}, n AS (SELECT script_id, count(*) AS n_nodes, bool_or(node_id = 'T0' AND type = 'choice') AS a FROM nodes GROUP BY script_id),
        e AS (SELECT script_id, count(*) AS n_edges, bool_or(from_id = 'T0' AND to_id = 'T1') AS b FROM edges GROUP BY script_id)
        SELECT script_id, n_nodes, coalesce(n_edges, 0) AS n_edges,
               n_nodes = 4 AND coalesce(n_edges, 0) = 5 AND a AND coalesce(b, false) AS correct FROM n LEFT JOIN e USING (script_id)""",
)
def grade_graph(spark, folder):
    nodes, edges = _graph(spark, folder)
    return grading.grade_graph(
        nodes, edges, 4, 5,
        [(F.col("node_id") == "T0") & (F.col("type") == "choice")],
        [(F.col("from_id") == "T0") & (F.col("to_id") == "T1")],
    )


# --- versions -------------------------------------------------------------------------

VERSIONS = """
v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, o_totalprice AS value,
             lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def _versions(spark, folder):
    rows = bindings.versions(spark, folder)
    return temporal.row_versions(rows, ["o_custkey"], ["valid_from", "o_orderkey"])


@query(
    "row_versions",
    f"""WITH {VERSIONS} SELECT o_custkey, o_orderkey, value, {sql_stamp('valid_from')} AS valid_from,
        {sql_stamp('valid_to')} AS valid_to FROM v""",
)
def row_versions(spark, folder):
    return _versions(spark, folder).withColumns({c: stamp(c) for c in ("valid_from", "valid_to")})


def _sql_at(at: str) -> str:
    return f"valid_from <= {at} AND (valid_to IS NULL OR {at} < valid_to)"


@query(
    "as_of",
    f"""WITH {VERSIONS} SELECT 'fixed' AS mode, o_custkey, o_orderkey, value FROM v WHERE {_sql_at("TIMESTAMP '1998-06-15 12:00:00'")}
        UNION ALL SELECT 'ago', o_custkey, o_orderkey, value FROM v WHERE {_sql_at("TIMESTAMP '1997-12-31 22:00:00'")}""",
)
def as_of(spark, folder):
    versions, keep = _versions(spark, folder), ["o_custkey", "o_orderkey", "value"]
    fixed = temporal.as_of(versions, "1998-06-15 12:00:00")
    ago = temporal.as_of_ago(versions, "1998-01-01 00:00:00", "2 HOURS")
    return fixed.select(F.lit("fixed").alias("mode"), *keep).unionByName(ago.select(F.lit("ago").alias("mode"), *keep))


@query(
    "versions_between",
    f"""WITH {VERSIONS} SELECT o_custkey, o_orderkey, value FROM v WHERE valid_from <= TIMESTAMP '1998-01-31'
        AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')""",
)
def versions_between(spark, folder):
    out = temporal.versions_between(_versions(spark, folder), "1998-01-01", "1998-01-31")
    return out.select("o_custkey", "o_orderkey", "value")


@query(
    "temporal_join_fixed",
    f"""WITH e AS (SELECT user_id, event_type, value, ts AS valid_from,
                     lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events),
          s AS (SELECT * FROM e WHERE {_sql_at("TIMESTAMP '2024-01-15 10:30:00'")})
        SELECT a.user_id, a.value AS price, b.value AS stock FROM s a JOIN s b USING (user_id)
        WHERE a.event_type = 'purchase' AND b.event_type = 'view'""",
)
def temporal_join_fixed(spark, folder):
    """Last purchase and last view of every user, both as of one instant."""
    events = table(spark, folder, "events").withColumn("valid_from", F.col("ts"))

    def side(kind, name):
        rows = events.where(F.col("event_type") == kind).select("user_id", "valid_from", "event_id", F.col("value").alias(name))
        return temporal.row_versions(rows, ["user_id"], ["valid_from", "event_id"]).drop("event_id")

    return temporal.temporal_join_fixed(
        side("purchase", "price"), side("view", "stock"), ["user_id"], "2024-01-15 10:30:00"
    )


@query(
    "temporal_join_asof",
    f"""WITH {VERSIONS} SELECT l.l_orderkey, l.l_partkey, o.o_custkey, {sql_stamp('l.l_shipdate')} AS shipped,
          v.value, {sql_stamp('v.valid_from')} AS valid_from
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        LEFT JOIN v ON v.o_custkey = o.o_custkey AND v.valid_from <= l.l_shipdate
          AND (v.valid_to IS NULL OR l.l_shipdate < v.valid_to)""",
)
def temporal_join_asof(spark, folder):
    """Every order line with the version of its customer in force when it shipped."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = temporal.temporal_join_asof(
        keyed_join(lines, orders, ["l_orderkey"]), bindings.versions(spark, folder),
        "o_custkey", "l_shipdate", "value", "o_orderkey",
    )
    return out.select(
        "l_orderkey", "l_partkey", "o_custkey", stamp("l_shipdate").alias("shipped"), "value",
        stamp("valid_from").alias("valid_from"),
    )


@query(
    "temporal_agg",
    f"""WITH d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS avg_daily,
                          max(l_quantity) AS mx, min(l_quantity) AS mn FROM lineitem GROUP BY ALL),
          w AS (SELECT *, time_bucket(INTERVAL '7 days', day::TIMESTAMP, TIMESTAMP '1970-01-01') AS week FROM d)
        SELECT l_partkey, CAST(day AS VARCHAR) AS day, round(avg_daily, 6) AS avg_daily,
               max(mx) OVER (PARTITION BY l_partkey, week) AS max_weekly,
               min(mn) OVER (PARTITION BY l_partkey, week) AS min_weekly FROM w""",
)
def temporal_agg(spark, folder):
    out = temporal.temporal_agg(table(spark, folder, "lineitem"), "l_partkey", "l_shipdate", "l_quantity", "l_quantity")
    return out.withColumns({"day": F.to_date("day").cast("string"), "avg_daily": F.round("avg_daily", 6)})
