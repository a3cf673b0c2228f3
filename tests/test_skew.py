"""Hot keys: sliced windows and salted joins give what plain ones give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.plans import skew
from episodica.session import prepare


def rows(spark, n=600):
    """A third of the rows under one key, a sixth under a null key, many ties."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 != 1, F.concat(F.lit("k"), F.col("id") % 11))
    value = F.when(F.col("id") % 4 != 0, (F.col("id") * 7919) % 101)
    return spark.range(n).select(key.alias("key"), F.floor(F.col("id") / 9).alias("at"), "id", value.alias("v"))


@pytest.mark.parametrize("slice_rows", [7, 50, 10_000])
def test_ordered_equals_plain_windows(spark, slice_rows):
    prepare(spark)
    df = rows(spark)
    v = F.col("v")
    got = skew.ordered(
        df, ["key"], ["at", "id"], number="n", total="t", running={"r": v}, carry={"c": v},
        previous={"p": v}, following={"f": v}, slice_rows=slice_rows,
    )
    w = Window.partitionBy("key").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.count("*").over(Window.partitionBy("key")).alias("t"),
        F.sum(v).over(upto).alias("r"), F.last(v, ignorenulls=True).over(upto).alias("c"),
        F.lag(v).over(w).alias("p"), F.lead(v).over(w).alias("f"),
    )
    names = want.columns
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))


def test_slices_are_bounded(spark):
    prepare(spark)
    sliced = skew.slice_keys(rows(spark, 3000), ["key"], ["at", "id"], 50)
    largest = sliced.rows.groupBy("key", skew.SLICE).count().agg(F.max("count")).first()[0]
    assert sliced.split and sliced.largest == 1000 and largest < 200


def jobs_of(spark, build):
    """Jobs that ``build`` runs before its result is used, and the result."""
    group = f"build-{id(build)}"
    spark.sparkContext.setJobGroup(group, group)
    out = build()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_joins_and_windows_of_small_tables_count_nothing(spark):
    prepare(spark)
    fact, dim = rows(spark), spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "key string, d int")
    for how in ("inner", "left", "left_anti", "left_semi"):
        n, got = jobs_of(spark, lambda: skew.keyed_join(fact, dim, ["key"], how))
        assert n == 0 and got.count() == fact.join(dim, ["key"], how).count()
    assert jobs_of(spark, lambda: skew.ordered(fact, ["key"], ["at", "id"], number="n"))[0] == 0


def test_rewards_read_the_events_few_times(spark):
    from episodica.plans import load_all
    from episodica.plans.registry import QUERIES

    load_all()
    n, out = jobs_of(spark, lambda: QUERIES["reward_episode"](spark, "/root/testdata/sf0.001"))
    assert n <= 8
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 6
