import numpy as np
from pyspark.sql import functions as F

from episodica.llm import neighbours


def table(spark, scratch, name, rows, kind="array<float>"):
    path = str(scratch / f"{name}.parquet")
    spark.createDataFrame(rows, f"vec_id long, embedding {kind}, row string, list string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def brute(ids, x, one, k=10):
    far = np.sqrt(((x - x[one]) ** 2).sum(1))
    far[one] = np.inf
    return far, np.lexsort((ids, far))[: min(k, len(ids) - 1)]


def test_recall_against_brute_force(spark, scratch):
    r = np.random.default_rng(1)
    middle = r.normal(size=(8, 24))
    x = (middle[r.integers(0, 8, 3000)] + r.normal(size=(3000, 24))).astype(np.float32).astype(float)
    df = table(spark, scratch, "plain", [(i, v.tolist(), "own", "own") for i, v in enumerate(x)])
    got = {}
    for row in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row)
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, rows in got.items():
        far, want = brute(np.arange(3000), x, q)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(r["score"] - far[r["vec_id"]]) < 1e-12 for r in rows)
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        hits += len({r["vec_id"] for r in rows} & set(want.tolist()))
    assert hits >= 0.9 * 300


def test_data_without_clusters_probe_more(spark, scratch):
    r = np.random.default_rng(6)
    even, tight = r.normal(size=(3000, 16)), r.normal(size=(12, 16))[r.integers(0, 12, 3000)] * 9 + r.normal(size=(3000, 16))
    counts = []
    for x in (even, tight):
        middle = neighbours.centres(x, 16)
        counts.append(neighbours.probes_for(x, middle, 10, 0.97))
    assert counts[0] > 8 > counts[1]
    df = table(spark, scratch, "even", [(i, v.tolist(), "own", "own") for i, v in enumerate(even)], "array<double>")
    found = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    hits = sum(r["vec_id"] in set(brute(np.arange(3000), even, r["query_id"])[1].tolist()) for r in found)
    assert hits >= 0.93 * 300


def test_messy_vectors(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0], "a", "b") for i in range(0, 40)] + [(100, [1.0, 2.0, 4.0], "a", "b"), (101, [9.0, 9.0, 9.0], "a", "b")]
    rows += [
        (200, None, "a", "b"), (201, [0.0, 0.0, 0.0], "a", "b"), (202, [1.0, None, 1.0], "a", "b"), (203, [1.0, nan, 1.0], "a", "b"),
        (204, [inf, 1.0, 1.0], "a", "b"), (205, [1.0, 2.0], "a", "b"), (None, [1.0, 2.0, 3.0], "a", "b"), (206, [], "a", "b"),
    ]
    got = neighbours.search(table(spark, scratch, "messy-vectors", rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(i, 0.0) for i in range(1, 11)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 100] == [(i, 1.0) for i in range(10)]


def test_few_and_no_vectors(spark, scratch):
    few = table(spark, scratch, "few", [(0, [1.0, 0.0], "a", "b"), (1, [0.0, 1.0], "a", "b"), (0, [1.0, 0.0], "a", "b")], "array<double>")
    got = neighbours.search(few, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(none, F.col("vec_id") % 100 == 0).count() == 0


def test_hot_list_and_short_lists(spark, scratch, monkeypatch):
    """A third are copies, blocks are tiny, and one list is probed: all queries still get ten."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    monkeypatch.setattr(neighbours, "TARGET", 0.01)
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 8))
    x[::3] = x[0]
    df = table(spark, scratch, "hot", [(i, v.tolist(), "a", "b") for i, v in enumerate(x)], "array<double>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    assert len(got) == 90
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 300) == [0, *range(3, 30, 3)]


def test_abandoned_candidates_are_far(spark):
    r = np.random.default_rng(3)
    q, c = r.normal(size=(5, 64)), r.normal(size=(4000, 64))
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0]
    left = list(neighbours.scan(q, c, turn, 10))
    assert max(map(len, left)) < 200
    for one, alive in zip(q, left):
        far = ((c - one) ** 2).sum(1)
        assert len(set(np.argsort(far)[:10].tolist()) & set(alive.tolist())) >= 9
