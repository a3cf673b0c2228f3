import zlib
from collections import Counter

from pyspark.sql import functions as F

from episodica.llm import sharding


def test_permutation_is_one_and_inverts(spark):
    for n in (1, 2, 3, 7, 26, 100, 1000, 1023):
        made = sharding.permutation(spark, n, 3)
        df = made.apply(spark.range(n).withColumnRenamed("id", "x"), "x", "y")
        back = made.apply(df, "y", "z", inverse=True).collect()
        assert sorted(r["y"] for r in back) == list(range(n))
        assert all(r["x"] == r["z"] for r in back)


def test_permutation_moves_rows_and_follows_the_seed(spark):
    n = 2000
    places = [
        [r["y"] for r in sharding.permutation(spark, n, seed).apply(spark.range(n), "id", "y").orderBy("id").collect()] for seed in (1, 1, 2)
    ]
    assert places[0] == places[1] != places[2]
    steps = Counter((b - a) % n for a, b in zip(places[0], places[0][1:]))
    assert steps.most_common(1)[0][1] < 20  # no stride


def test_messy_rows(messy):
    rows, made = sharding.shard_rows(sharding.digests(messy), ["doc_id", "text_crc32", "size"], 7)
    got = rows.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in messy.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert sorted(r["row_number"] for r in got) == list(range(len(got)))
    again = sharding.row_at(rows.drop("place"), made, 7, "found").where(F.col("found") != F.col("row_number"))
    assert again.count() == 0


def test_more_shards_than_rows_and_no_rows(messy, empty):
    rows, _ = sharding.shard_rows(sharding.digests(messy.limit(3)), ["doc_id"], 40)
    assert [r["slot"] for r in rows.collect()] == [0, 0, 0]
    assert sharding.shard_rows(sharding.digests(empty), ["doc_id"], 40)[0].count() == 0


def test_no_python_in_the_plan(messy):
    rows, _ = sharding.shard_rows(sharding.digests(messy), ["doc_id"], 7)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_plans_stay_small(spark):
    """Planning takes no longer where a walk is long."""
    import time

    for n in [0, 1, 7, 17, 26, 31, 37, 50, 131, 10_001]:
        made = sharding.permutation(spark, n, 1)
        df = made.apply(spark.range(n).withColumnRenamed("id", "x"), "x", "y")
        back = made.apply(df, "y", "z", inverse=True)
        began = time.perf_counter()
        back._jdf.queryExecution().executedPlan()
        assert time.perf_counter() - began < 5, n
        got = back.collect()
        assert sorted(r["y"] for r in got) == list(range(n)) and all(r["x"] == r["z"] for r in got)


def test_folded_rounds_are_the_network(spark):
    """The fold against rounds written out in Python, with the same keys."""
    n = 26
    made = sharding.permutation(spark, n, 3)
    pairs = spark.range(max(made.a, made.b)).crossJoin(spark.range(sharding.ROUNDS).select(F.col("id").cast("int").alias("k")))
    keys = {(r["id"], r["k"]): r["h"] for r in pairs.select("id", "k", F.xxhash64("id", "k", F.lit(3).cast("long")).alias("h")).collect()}

    def enciphered(x):
        left, right = divmod(x, made.b)
        for k in range(sharding.ROUNDS):
            if k % 2:
                left = (left + keys[right, k]) % made.a
            else:
                right = (right + keys[left, k]) % made.b
        return left * made.b + right

    for r in made.apply(spark.range(n), "id", "y").collect():
        y = enciphered(r["id"])
        while y >= n:
            y = enciphered(y)
        assert y == r["y"]
