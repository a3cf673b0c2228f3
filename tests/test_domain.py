"""Golden rows of levels, series, dialogue, records, signatures and versions."""

import hashlib
import hmac
import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions.crypto import with_hmac
from episodica.operators import dialogue, events, generate, hpfilter, levels, records, temporal
from episodica.session import fresh_dir, prepare
from episodica.sources import files, recordfiles

STATIONS = {  # id: (threshold, daily levels)
    "04124000": (15.0, [15.2, 16.1, 15.8, 14.9, 15.5, 16.0, 15.3]),
    "04101800": (22.0, [22.1, 23.5, 22.8, 24.1, 23.0, 21.9, 22.5]),
    "04097500": (10.5, [10.5, 11.2, 10.8, 11.1, 10.3, 9.8, 9.5]),
    "04166500": (8.1, [8.2, 8.5, 7.9, 7.8, 8.0, 7.5, 7.3]),
    "04999999": (6.0, [5.0, 4.8, 5.1, 4.9, 5.0, 4.7, 4.6]),
    "09999999": (None, [99.0]),
}


def test_flood_days(spark):
    prepare(spark)
    daily = spark.createDataFrame([(s, d, x) for s, (_, xs) in STATIONS.items() for d, x in enumerate(xs)], "station_id string, day int, level double")
    limits = spark.createDataFrame([(s, t) for s, (t, _) in STATIONS.items() if t], "station_id string, flood double")
    want = [("04101800", 6), ("04124000", 6), ("04097500", 4), ("04166500", 2)]
    assert [tuple(r) for r in levels.ranked(levels.flood_days(daily, limits)).collect()] == want
    assert levels.flood_days(daily.limit(0), limits).count() == 0


def test_severity_classes(spark):
    prepare(spark)
    rows = [(x, 1.0, 2.0, 3.0, 4.0) for x in (0.9, 1.0, 2.0, 3.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "level double, action double, flood double, moderate double, major double").coalesce(1)
    got = [r[0] for r in df.select(levels.severity(F.col("level"))).collect()]
    assert got == ["normal", "action", "minor", "moderate", "major", "major"]


def test_failure_runs_and_rate_limit(spark):
    prepare(spark)
    marks = "fffsffsfffff"
    df = spark.createDataFrame([("k", i, c == "f") for i, c in enumerate(marks)], "k string, at int, bad boolean")
    for slice_rows in (2, 1000):
        runs = levels.consecutive_failures(df, ["k"], ["at"], F.col("bad"), slice_rows=slice_rows)
        assert sorted((r.first["at"], r.last["at"], r.failures) for r in runs.collect()) == [(0, 2, 3), (7, 11, 5)]
    seconds = [3590, 3595, 3599, 3600, 3649, 3650, 3651, 3659, 3660]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(seconds)], "k string, i int, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = [r.in_span for r in levels.rate_limit_flag(df, "k", "ts", limit=5).orderBy("i").collect()]
    assert got == [sum(s - 59 <= o <= s for o in seconds) for s in seconds]


def cycle_series():
    """Two annual series of 50 points from a fixed seed: trend, shared cycle, own noise."""
    rng = np.random.RandomState(42)
    n = 50
    trend, cycle = np.linspace(10, 12, n), 0.05 * np.sin(np.linspace(0, 4 * np.pi, n))
    a, b = (0.01 * rng.randn(n) for _ in range(2))
    return np.exp(trend + cycle + a), np.exp(trend + 0.8 * cycle + b)


def test_cycle_correlation(spark):
    prepare(spark)
    a, b = cycle_series()
    assert a[0] == pytest.approx(22136.146542207392, rel=1e-12)
    rows = [(s, t, float(v)) for s, xs in (("a", a), ("b", b)) for t, v in enumerate(xs)]
    series = spark.createDataFrame(rows, "series_id string, t int, value double")
    pairs = spark.createDataFrame([("a", "b")], "series_a string, series_b string")
    got = {lamb: hpfilter.cycle_correlation(series, pairs, lamb).first().correlation for lamb in (100, 1600, 14400)}
    assert got == {100: 0.62487, 1600: 0.8953, 14400: 0.92131}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 60])
def test_trend_against_dense_solve(n):
    y = np.cos(np.arange(n) / 3) + np.arange(n)
    bend = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        bend[i, i : i + 3] = 1, -2, 1
    want = np.linalg.solve(np.eye(n) + 100 * bend.T @ bend, y)
    assert np.allclose(hpfilter.trend(y, 100.0), want, atol=1e-10)


def test_long_series_in_blocks(spark):
    """Overlapping blocks and hot-key slices give the trend of the whole series."""
    prepare(spark)
    n, lamb = 6000, 100.0
    y = np.cumsum(np.random.RandomState(1).randn(n))
    rows = [("s", int(t) * 3, float(v)) for t, v in enumerate(y)]
    series = spark.createDataFrame(rows, "series_id string, t int, value double")
    out = hpfilter.hp_filter(series, lamb, block_points=700, slice_rows=900).orderBy("t").collect()
    assert len(out) == n
    assert np.allclose([r.trend for r in out], hpfilter.trend(y, lamb), atol=1e-10)


@pytest.mark.parametrize("lamb", [100.0, 1600.0, 14400.0])
def test_blocks_of_a_trending_series(spark, lamb):
    """Large, rising values: the blocks differ from one solve by less than 1e-11 of the values."""
    prepare(spark)
    y = 1e6 + 250.0 * np.arange(3000) + 1e3 * np.random.RandomState(2).randn(3000)
    series = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(y)], "series_id string, t int, value double")
    out = hpfilter.hp_filter(series, lamb, block_points=700, slice_rows=900).orderBy("t").collect()
    assert np.abs(np.array([r.trend for r in out]) - hpfilter.trend(y, lamb)).max() < 1e-11 * y.max()


@pytest.mark.parametrize("lamb, least", [(100, 1e-13), (1600, 2e-12), (14400, 2e-11)])
def test_blocks_give_the_trend_of_one_solve(spark, lamb, least):
    """Any number of blocks against a dense solve; the tolerance is that of doubles at this lambda."""
    prepare(spark)
    r = np.random.default_rng(lamb)
    ys = {f"s{n}": r.normal(size=n).cumsum() + 9 for n in (1, 2, 3, 7, 8, 16, 17, 40, 250)}
    rows = [(k, t, float(v)) for k, y in ys.items() for t, v in enumerate(y)] + [(None, t, float(v)) for t, v in enumerate(ys["s40"])]
    series = spark.createDataFrame(rows, "series_id string, t long, value double")
    for points in (8, 9, 50, 20_000):
        found = {}
        for row in hpfilter.hp_filter(series, float(lamb), block_points=points).orderBy("series_id", "t").collect():
            found.setdefault(row.series_id, []).append(row.trend)
        for name, y in {**ys, None: ys["s40"]}.items():
            bends = np.diff(np.eye(len(y)), 2, axis=0) if len(y) > 2 else np.zeros((0, len(y)))
            want = np.linalg.solve(np.eye(len(y)) + lamb * bends.T @ bends, y)
            assert np.abs(np.array(found[name]) - want).max() < least * np.abs(y).max(), (name, points)


SCRIPT = """[GateScene]
Guard: Halt! State your name. -> NameChoice

[NameChoice]
1. I am Sir Aldric. -> KnightPath
2. Just a traveler. -> TravelerPath

[KnightPath]
Captain: Welcome, knight! -> End

[TravelerPath]
Guard: Move along then. -> End

[End]
Narrator: The story continues...
"""


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_dialogue(spark, slice_rows):
    prepare(spark)
    lines = dialogue.lines_of(spark.createDataFrame([("s", SCRIPT)], "script_id string, text string"))
    scenes = dialogue.scene_lines(lines, ["line_no"], slice_rows)
    nodes = dialogue.dialogue_nodes(scenes, ["line_no"])
    edges = dialogue.dialogue_edges(scenes, ["line_no"])
    got = {r.node_id: (r.type, r.speaker, r.text) for r in nodes.collect()}
    assert got == {
        "GateScene": ("line", "Guard", "Halt! State your name."), "NameChoice": ("choice", "", ""),
        "KnightPath": ("line", "Captain", "Welcome, knight!"), "TravelerPath": ("line", "Guard", "Move along then."),
        "End": ("line", "Narrator", "The story continues..."),
    }
    assert sorted((r.from_id, r.to_id, r.text) for r in edges.collect()) == [
        ("GateScene", "NameChoice", ""), ("KnightPath", "End", ""),
        ("NameChoice", "KnightPath", "1. I am Sir Aldric."), ("NameChoice", "TravelerPath", "2. Just a traveler."),
        ("TravelerPath", "End", ""),
    ]
    assert dialogue.dangling_edges(nodes, edges).count() == 0
    without = dialogue.dangling_edges(nodes.where("node_id <> 'End'"), edges.unionByName(edges))
    assert sorted(r.message for r in without.collect()) == [
        "Edge 'KnightPath'->'End' points to missing node 'End'", "Edge 'TravelerPath'->'End' points to missing node 'End'",
    ]
    place = fresh_dir(spark, "graphs")
    assert [(r.script_id, r.nodes, r.edges) for r in files.write_graphs(nodes, edges, place).collect()] == [("s", len(got), 5)]
    back_nodes, back_edges = files.read_graphs(spark, place)
    assert {(r.node_id, r.type) for r in back_nodes.collect()} == {(k, v[0]) for k, v in got.items()}
    assert back_edges.count() == 5
    (document,) = [json.loads(r.value) for r in spark.read.text(place, wholetext=True).collect()]
    assert {n["id"] for n in document["nodes"]} == set(got) and len(document["edges"]) == 5


def test_graph_files_of_any_size_and_name(spark):
    """Odd names and texts, a graph without edges or nodes, one far above a million rows."""
    prepare(spark)
    odd = [("a/b %25 é", 'x\ny "q", \u2028 \\,', None), (None, ",", "v"), ("", "t,", ""), ("null", "", "p")]
    few = spark.createDataFrame([(i, f"n{k}", t, s, "line") for k, (i, t, s) in enumerate(odd)], "script_id string, node_id string, text string, speaker string, type string")
    many = spark.range(1_200_000).selectExpr("'big' as script_id", "cast(id as string) as node_id", "concat('text ', id) as text", "'s' as speaker", "'line' as type")
    nodes = few.unionByName(many)
    edges = spark.range(800_000).selectExpr("'big' as script_id", "cast(id as string) as from_id", "cast(id + 1 as string) as to_id", "'' as text")
    edges = edges.unionByName(spark.createDataFrame([("only", "a", "b", "x")], edges.schema))
    place = fresh_dir(spark, "graphs")
    listed = {r.script_id: (r.nodes, r.edges) for r in files.write_graphs(nodes, edges, place).collect()}
    assert listed == {**{i: (1, 0) for i, _, _ in odd}, "big": (1_200_000, 800_000), "only": (0, 1)}
    back_nodes, back_edges = files.read_graphs(spark, place)
    same = lambda a, b: a.exceptAll(b.select(a.columns)).count() + b.select(a.columns).exceptAll(a).count()
    assert same(nodes, back_nodes) == 0 and same(edges, back_edges) == 0
    path = next(p for p in Path(place).iterdir() if p.name == "id-only.json")
    assert json.loads(path.read_text()) == {"nodes": [], "edges": [{"from": "a", "to": "b", "text": "x"}]}


def test_pivot_loses_no_kind(spark):
    prepare(spark)
    rows = spark.createDataFrame([(1, "view", 1.0), (1, "odd", 2.5), (1, None, 4.0), (2, "click", 3.0), (2, "other", 7.0)], "user_id int, event_type string, value double")
    got = events.pivot_sum(rows, ["user_id"], "event_type", "value", ["click", "view"]).orderBy("user_id").collect()
    assert [tuple(r) for r in got] == [(1, None, 1.0, 6.5), (2, 3.0, None, 7.0)]


def test_last_line_wins_and_scene_names_may_repeat(spark):
    prepare(spark)
    text = "[A]\nX: one -> B\nY: two -> C\nZ: three\nnoise\n[A]\n1. go\n[Empty]"
    scenes = dialogue.scene_lines(dialogue.lines_of(spark.createDataFrame([("s", text)], "script_id string, text string")), ["line_no"])
    nodes = dialogue.dialogue_nodes(scenes, ["line_no"]).orderBy("scene_at").collect()
    assert [(r.node_id, r.type, r.speaker, r.text) for r in nodes] == [
        ("A", "line", "Z", "three"), ("A", "choice", "", ""), ("Empty", "line", "", ""),
    ]
    assert [(r.from_id, r.to_id) for r in dialogue.dialogue_edges(scenes, ["line_no"]).collect()] == [("A", "C")]


HEADERS = [
    ("4E4F564202010000002A000502BBA956", 42, (True, False, True), 45853014),
    ("4E4F5642020100000001000046C9F4D8", 1, (False, False, False), 1187640536),
]


def decoded(spark, data, order="big"):
    df = spark.createDataFrame([(bytearray(d),) for d in data], "data binary").coalesce(1)
    names = F.array(F.lit("compressed"), F.lit("encrypted"), F.lit("checksummed"))
    return [r.h for r in df.select(records.decode_header(F.col("data"), F.lit("NOVB"), names, order).alias("h")).collect()]


def test_golden_headers(spark):
    prepare(spark)
    seen = decoded(spark, [bytes.fromhex(h) for h, *_ in HEADERS])
    for row, (_, count, flags, crc) in zip(seen, HEADERS):
        assert (row.version, row.record_count, row.checksum) == (513, count, crc)
        got = tuple(row.flag_values[n] for n in ("compressed", "encrypted", "checksummed"))
        assert got == flags and row.crc_ok and row.magic_ok


def test_broken_headers(spark):
    prepare(spark)
    good = bytes.fromhex(HEADERS[0][0])
    flipped = good[:9] + bytes([good[9] ^ 1]) + good[10:]
    seen = decoded(spark, [flipped, b"XXXX" + good[4:], good[:11], b""])
    assert [r.crc_ok for r in seen] == [False] * 4
    assert [r.magic_ok for r in seen] == [True, False, True, False]
    assert seen[2].flags is None and seen[2].record_count == 42


@pytest.mark.parametrize("order", ["big", "little"])
def test_headers_match_struct(spark, order):
    """High bytes, which are not valid UTF-8, in every field."""
    prepare(spark)
    counts = [0, 1, 200, 1000, 0x80FF, 0xDEADBEEF, 0xFFFFFFFF]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, c long")
    flags = F.array(F.lit(True), F.lit(False), F.lit(True))
    made = df.select("i", "c", records.encode_header(F.lit("NOVB"), F.lit(0x0309), F.col("c"), flags, order).alias("d"))
    mark = ">" if order == "big" else "<"
    for row in made.collect():
        body = b"NOVB" + struct.pack(mark + "HIH", 0x0309, row.c, 5)
        assert bytes(row.d) == body + struct.pack(mark + "I", zlib.crc32(body))
    back = decoded(spark, [bytes(r.d) for r in made.orderBy("i").collect()], order)
    assert [r.record_count for r in back] == counts and all(r.crc_ok for r in back)


RECORDS = {  # bytes: fields, next offset
    "000201000361676500000004000000190300046E616D6500000005416C696365": ([("age", "int32", 25), ("name", "string", "Alice")], 32),
    "00010400066163746976650000000101": ([("active", "bool", True)], 16),
    "000102000573636F7265000000084004000000000000": ([("score", "float64", 2.5)], 22),
    "0000": ([], None),
}


def _value(row):
    return {"int32": row.int_value, "float64": row.float_value, "string": row.string_value, "bool": row.bool_value}[row.type]


def test_golden_records(spark):
    prepare(spark)
    rows = [(i, bytearray(b"\x00" * i + bytes.fromhex(h)), i) for i, h in enumerate(RECORDS)]
    out = records.decode_records(spark.createDataFrame(rows, "record_id long, data binary, offset int")).collect()
    for i, (fields, end) in enumerate(RECORDS.values()):
        mine = sorted((r for r in out if r.record_id == i), key=lambda r: r.field_no)
        assert [(r.name, r.type, _value(r)) for r in mine] == fields
        assert not mine or mine[-1].next_offset == end + i


def test_broken_records(spark):
    prepare(spark)
    whole = bytes.fromhex(next(iter(RECORDS)))
    rows = [(n, bytearray(whole[:n]), 0) for n in range(len(whole))] + [(99, bytearray(b"\x00\x01\x09\x00\x00\x00\x00\x00\x00"), 0)]
    rows.append((98, bytearray(bytes.fromhex("00010100016100000002AAAA")), 0))
    out = records.decode_records(spark.createDataFrame(rows, "record_id long, data binary, offset int")).collect()
    assert len(out) == len(rows) and all(r.error for r in out)


def test_record_round_trip(spark):
    prepare(spark)
    rows = [(1, -2147483648, -0.1, "é中", True), (2, 2147483647, float("inf"), "", False), (3, -1, 5e-324, "x" * 300, True)]
    df = spark.createDataFrame(rows, "record_id long, i int, f double, s string, b boolean")
    data = records.encode_record(
        [records.int32_field("i", F.col("i")), records.float64_field("f", F.col("f")),
         records.string_field("s", F.col("s")), records.bool_field("b", F.col("b"))]
    )
    out = records.decode_records(df.select("record_id", data.alias("data"), F.lit(0).alias("offset"))).collect()
    back = {(r.record_id, r.name): _value(r) for r in out}
    assert back == {(row[0], n): v for row in rows for n, v in zip("ifsb", row[1:])}


def test_golden_signatures(spark):
    prepare(spark)
    rows = [("test_key_123", 1700000000), ("another_key", 1700000001), ("k", 0)]
    df = spark.createDataFrame(rows, "api_key string, ts long").coalesce(1)
    fixed = {"method": "GET", "algo": "sha256", "signing": "key:timestamp", "header": "X-{api}-Auth", "api_name": "Zephyr", "prefix": "ZPH"}
    out = generate.sign_requests(df.withColumns({k: F.lit(v) for k, v in fixed.items()})).collect()
    sigs = ["0bqba2tT8U1vBFA9P8PO0WbmT/nFgFDtvhWqzy4zJeE=", "zeoxpxOwIowrbFetmVli+crWKioB+yPk+89tJKwU5y0=", "MpWuFjPOpcJHNeSmFzuYFH2zrx88syl+YNTngFZ8a+g="]
    assert {r.header_name for r in out} == {"X-Zephyr-Auth"}
    assert [r.header_value for r in out] == [f"ZPH {k}:{s}:{t}" for (k, t), s in zip(rows, sigs)]


@pytest.mark.parametrize("algo", ["md5", "sha256", "sha384", "sha512"])
def test_hmac_of_all_hashes(spark, algo):
    prepare(spark)
    keys = ["", "k", "6" * 63, "\\" * 64, "é" * 32, "x" * 65, "y" * 128, "z" * 129, "w" * 500]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    out = with_hmac(df, "h", F.lit(algo), F.col("k"), F.concat(F.col("k"), F.lit(":m"))).orderBy("i").collect()
    for row in out:
        assert bytes(row.h) == hmac.new(row.k.encode(), f"{row.k}:m".encode(), getattr(hashlib, algo)).digest()


def test_versions(spark):
    prepare(spark)
    rows = [("k", 1, "2024-01-01", 1.0), ("k", 2, "2024-01-05", 2.0), ("k", 3, "2024-01-05", 3.0), ("k", 4, "2024-01-09", 4.0)]
    df = spark.createDataFrame(rows, "key string, id int, d string, value double")
    df = df.withColumn("valid_from", F.col("d").cast("timestamp_ntz")).drop("d")
    for slice_rows in (1, 100):
        versions = temporal.row_versions(df, ["key"], ["valid_from", "id"], slice_rows)
        at = lambda t: [r.value for r in temporal.as_of(versions, t).collect()]
        assert at("2023-12-31") == [] and at("2024-01-01") == [1.0] and at("2024-01-04") == [1.0]
        assert at("2024-01-05") == [3.0] and at("2024-01-09") == [4.0] and at("2030-01-01") == [4.0]
        ago = temporal.as_of_ago(versions, "2024-01-09 01:00:00", "2 HOURS")
        assert [r.value for r in ago.collect()] == [3.0]
        between = temporal.versions_between(versions, "2024-01-05", "2024-01-08")
        assert sorted(r.value for r in between.collect()) == [3.0]
        facts = spark.createDataFrame([("k", i, f"2024-01-{d:02d}") for i, d in enumerate((1, 5, 7, 9))] + [("k", 9, "2023-01-01"), ("q", 8, "2024-01-09")], "key string, f int, t string")
        facts = facts.withColumn("t", F.col("t").cast("timestamp_ntz"))
        joined = temporal.temporal_join_asof(facts, df, "key", "t", "value", "id", slice_rows)
        assert {r.f: r.value for r in joined.collect()} == {0: 1.0, 1: 3.0, 2: 3.0, 3: 4.0, 9: None, 8: None}


def test_exact_percentiles_of_a_hot_window(spark):
    prepare(spark)
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), ((F.col("id") * 37) % 997).cast("double").alias("v"), "id")
    values = {"hot": sorted((i * 37) % 997 for i in range(900)), "cold": sorted((i * 37) % 997 for i in range(900, 1000))}
    for slice_rows in (50, 10_000):
        out = events.exact_percentiles(df, ["k"], "v", "id", {"p50": 0.5, "p99": 0.99}, slice_rows=slice_rows)
        for row in out.collect():
            xs = values[row.k]
            assert (row.p50, row.p99) == (xs[-(-len(xs) // 2) - 1], xs[-(-len(xs) * 99 // 100) - 1])


def test_canary_gate_limits(spark):
    prepare(spark)
    gates = [("a", "p99_latency_ms < 200 AND error_rate < 0.005"), ("b", "error_rate < 0.01"), ("c", None)]
    metrics = [("a", 199.0, 0.004), ("a", 200.0, 0.0), ("b", 999.0, 0.009), ("b", 1.0, 0.01), ("c", 1.0, 1.0)]
    out = events.canary_gate(
        spark.createDataFrame(metrics, "phase string, p99 double, error_rate double"),
        spark.createDataFrame(gates, "phase string, metrics_gate string"),
    ).collect()
    assert sorted((r.phase, r.gate_ok) for r in out) == [("a", False), ("a", True), ("b", False), ("b", True), ("c", True)]


def test_pack_refuses_what_does_not_fit(spark):
    from episodica.functions.binary import pack

    prepare(spark)
    cases = [(0, 2, "0000"), (65535, 2, "FFFF"), (65536, 2, None), (-1, 2, "FFFF"), (-32768, 2, "8000"), (-32769, 2, None), (2**32 + 5, 4, None), (2**40, 8, "0000010000000000"), (None, 2, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v long")
    for i, (_, size, want) in enumerate(cases):
        assert df.where(F.col("i") == i).select(F.hex(pack(F.col("v"), size))).first()[0] == want


def test_records_keep_nan_null_and_errors(spark):
    from episodica.operators import records

    prepare(spark)
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "record_id long, v double").coalesce(1)
    made = df.select("record_id", F.lit(0).alias("field_no"), records.float64_field("f", F.col("v")).alias("field"))
    encoded = records.encode_records(made)
    errors = {r.record_id: r.error for r in encoded.collect()}
    assert errors == {1: None, 2: "a value does not fit its field", 3: None}
    extra = spark.createDataFrame([(4, bytearray(b"\x00"))], "record_id long, data binary")
    back = records.decode_records(encoded.select("record_id", "data").unionByName(extra).withColumn("offset", F.lit(0)))
    got = {r.record_id: r for r in back.collect()}
    assert got[1].float_value != got[1].float_value and got[3].float_value == 1.5
    assert got[2].error == "no data" and got[4].error.startswith("record ends")


def test_two_places_for_any_double(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    from episodica.functions.text import two_places

    prepare(spark)
    values = [0.125, 0.375, -0.125, 8.1, -8.05, 7.995, 12345.675, 2.5e15 + 0.5, 0.005, 0.015, -0.001, -0.0, 99.995, 1e9 + 0.125, 4503599627370495.5, 9.007199254740993e15, -1e18]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(two_places(F.col("v"))).collect()]
    assert got == [f"{Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_EVEN):.2f}" if v or str(v) == "0.0" else "-0.00" for v in values]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in odd.select(two_places(F.col("v"))).collect()] == ["infinity", "nan", None]


@pytest.mark.parametrize("span", [2000, 1 << 20])
def test_records_of_files_in_spans(spark, span):
    """Any cut of the files gives the records of one walk; a value that looks like records is not mistaken."""
    prepare(spark)
    trap = records.string_field("trap", F.lit("".join(map(chr, [0, 1, 3, 0, 1, 65, 0, 0, 0, 1, 66] * 30))))
    fields = F.when(F.col("id") % 7 == 3, records.encode_record([trap, trap])).when(F.col("id") % 11 == 5, records.encode_record([]))
    plain = records.encode_record([records.int32_field("n", F.col("id")), records.string_field("s", F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")))])
    data = spark.range(300).select("id", F.coalesce(fields, plain).alias("data"))
    place = fresh_dir(spark, "records")
    assert sum(r.records for r in recordfiles.write_records(data.repartition(2), place, file_bytes=9000).collect()) == 300
    heads = recordfiles.read_headers(spark, place, "RECS", ["a"]).collect()
    assert len(heads) > 2 and all(h.magic_ok and h.crc_ok for h in heads) and sum(h.record_count for h in heads) == 300
    index, rounds = recordfiles.record_index(spark, place, span)
    want = {(p.name, at) for p in Path(place).glob("*.bin") for at in offsets_of(p.read_bytes())}
    got = [(r.path.rsplit("/", 1)[-1], at) for r in index.collect() for at in r.offsets]
    assert len(got) == 300 and set(got) == want and 1 <= rounds <= 15
    rows = recordfiles.read_records(spark, place, span).collect()
    assert not [r for r in rows if r.error]
    assert sorted(r.int_value for r in rows if r.name == "n") == [i for i in range(300) if i % 7 != 3 and i % 11 != 5]
    assert sum(r.name == "trap" for r in rows) == 2 * len([i for i in range(300) if i % 7 == 3])


def offsets_of(data):
    at = 16
    while at < len(data):
        yield at
        at = max([at + 2, *[f["next_offset"] for f in records._fields(data, at)]])


def test_records_of_a_span_are_not_copied(spark, monkeypatch, tmp_path):
    """Records are decoded in the one buffer of their span, however many lie before them in it."""
    import pyarrow as pa

    body = b"".join(b"\0\1\1\0\1k\0\0\0\4" + i.to_bytes(4, "big") for i in range(500))
    path = tmp_path / "a.bin"
    path.write_bytes(bytes(16) + body)
    row = {"path": f"file://{path}", "size": 16 + len(body), "start": 0, "end": 16 + len(body), "first": 16, "next": 16 + len(body), "offsets": list(range(16, 16 + len(body), 14))}
    buffers, whole = set(), recordfiles.field_rows

    def watched(rows):
        rows = list(rows)
        buffers.update(id(getattr(data, "obj", data)) for _, data, _ in rows)
        return whole(rows)

    monkeypatch.setattr(recordfiles, "field_rows", watched)
    out = pa.Table.from_batches(recordfiles._decoded(iter([pa.RecordBatch.from_pylist([row], schema=recordfiles._WALKED_ARROW)])))
    assert out["int_value"].to_pylist() == list(range(500)) and out["next_offset"].to_pylist() == list(range(30, 31 + len(body), 14))[:500]
    assert len(buffers) == 1


def test_broken_and_empty_record_files(spark):
    prepare(spark)
    place = fresh_dir(spark, "records")
    data = spark.range(50).select(records.encode_record([records.int32_field("n", F.col("id"))]).alias("data"))
    recordfiles.write_records(data.coalesce(1), place).collect()
    (path,) = Path(place).glob("*.bin")
    whole = path.read_bytes()
    path.write_bytes(whole[:-3])
    (Path(place) / "head.bin").write_bytes(whole[:16])
    (Path(place) / "none.bin").write_bytes(b"")
    bad = bytearray(whole)
    bad[16 + 14 * 4 + 2] = 9  # the tag of the fifth record
    (Path(place) / "tag.bin").write_bytes(bad)
    rows = recordfiles.read_records(spark, place, 64).collect()
    found = {}
    for r in rows:
        found.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.error or r.int_value)
    assert sorted(found) == sorted([path.name, "tag.bin"])
    assert [x for x in found[path.name] if isinstance(x, int)] and sum(isinstance(x, str) for x in found[path.name]) == 1
    assert sorted(x for x in found["tag.bin"] if isinstance(x, int)) == [0, 1, 2, 3]
    assert [x for x in found["tag.bin"] if isinstance(x, str)] == ["unknown type tag 9"]
