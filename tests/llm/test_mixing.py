import random
from collections import Counter

from pyspark.sql import functions as F

from episodica.llm import mixing


def test_deadlines_are_met_and_deviation_stays_below_a_block():
    r = random.Random(1)
    for _ in range(60):
        counts = [r.randint(1, 40) for _ in range(r.randint(1, 12))]
        order, length, done = mixing.earliest_deadline(counts), sum(counts), Counter()
        assert sorted(order) == [(i, j) for i, c in enumerate(counts) for j in range(c)]
        for t, (i, _) in enumerate(order, 1):
            done[i] += 1
            for k, c in enumerate(counts):
                assert abs(done[k] * length - c * t) < length  # less than one block


def target(counts, weights, t):
    """Blocks of each source after ``t`` slots of the flow: exact weights, what has run out leaves its share to the others."""
    had, left, t = [0.0] * len(counts), {i for i, c in enumerate(counts) if c}, float(t)
    while left and t > 1e-9:
        total = sum(weights[i] for i in left)
        step = min(t, min((counts[i] - had[i]) * total / weights[i] for i in left))
        for i in left:
            had[i] += step * weights[i] / total
        t -= step
        left = {i for i in left if counts[i] - had[i] > 1e-9}
    return had


def test_deviation_from_the_given_weights_over_many_periods():
    """Against the target itself, not against rounded counts: 40 sources, and a hot one beside 2,000 small ones."""
    r = random.Random(2)
    sizes = [r.randint(50, 9000) for _ in range(40)]
    hot = [20_000] + [2] * 2000
    cases = [(sizes, [c**0.5 for c in sizes]), (hot, [0.101] + [0.899 / 2000] * 2000), ([3000, 3000, 5], [1.0, 0.999, 0.0001])]
    for counts, weights in cases:
        done, seen, t = [0] * len(counts), set(), 0
        for i, j, p in mixing.schedule(counts, weights):
            assert j == done[i]
            done[i] += 1
            t += 1
            seen.add(p)
            if t % 997 == 0 or t < 20:
                assert max(abs(a - b) for a, b in zip(done, target(counts, weights, t))) < 1 + 1e-6
        assert done == counts and len(seen) > 3


def test_given_weights_hold_in_the_table(spark):
    """Also for a share below one block in a thousand; a source without a weight comes last."""
    rows = [(i, "a" if i % 2 else "b") for i in range(20_000)] + [(i, "rare") for i in range(20_000, 20_040)] + [(i, "none") for i in range(20_040, 20_060)]
    weights = {"a": 3, "b": 1, "rare": 0.001}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=2).collect()
    slots = sorted({(r["slot"], r["source"]) for r in out})
    done = Counter()
    for t, (_, source) in enumerate(slots[:6000], 1):
        done[source] += 1
        assert all(abs(done[s] - w * t / 4.001) < 1 for s, w in weights.items())
    assert {s for _, s in slots[-10:]} == {"none"} and len(out) == 20_060


def test_mix_of_uneven_sources(spark, scratch):
    rows = [(i, "abcdefg"[min(6, i % 12)]) for i in range(3000)] + [(i, None) for i in range(3000, 3100)]
    path = str(scratch / "mix.parquet")
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(path)
    out = mixing.mix(spark.read.parquet(path), {"a": 2, "g": 1, "b": 1}, block=4).orderBy("place").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3100))
    assert len({r["place"] for r in out}) == 3100
    slots = [r["slot"] for r in out]
    assert sorted(set(slots)) == list(range(max(slots) + 1))
    assert Counter(Counter(slots).values())[4] >= len(set(slots)) - 8
    # Within the first period the shares are those of the blocks that each source has there.
    first = [r for r in out if r["period"] == 0 and r["place"] == r["slot"] * 4]
    total = Counter(r["source"] for r in first)
    done = Counter()
    for t, r in enumerate(first, 1):
        done[r["source"]] += 1
        assert all(abs(done[s] - n * t / len(first)) < 1 for s, n in total.items())
    per = {}
    for r in out:
        per.setdefault(r["source"], []).append(r["block"])
    assert all(b == sorted(b) for b in per.values())  # a source's blocks come in order


def test_same_seed_same_mix(spark, scratch):
    path = str(scratch / "mix.parquet")
    df = spark.read.parquet(path)
    a, b, c = ({r["doc_id"]: r["place"] for r in mixing.mix(d, seed=s).collect()} for d, s in ((df, 1), (df.repartition(5), 1), (df, 2)))
    assert a == b != c


def test_messy_rows(messy, empty):
    out = mixing.mixed_order(messy)
    assert out.columns == messy.columns
    assert Counter(map(str, out.collect())) == Counter(map(str, messy.collect()))
    assert mixing.mixed_order(empty).count() == 0
    assert mixing.mix(messy.select("doc_id", "source")).where(F.col("slot").isNull()).count() == 0


def test_columns_of_the_names_used_inside_keep_their_values(spark):
    from episodica.llm import jaccard

    text = F.concat(F.lit("one two three four five six "), (F.col("id") % 5).cast("string"))
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text"),
        *[(F.col("id") + i).alias(name) for i, name in enumerate(("__row", "__ROW_", "__place", "block", "place"))],
    )
    want = sorted(map(tuple, docs.collect()))
    mixed = mixing.mixed_order(docs)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == want
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == want[:5]
