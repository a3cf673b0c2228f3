import random

from pyspark.sql import functions as F

from episodica.llm import toxicity
from tests.llm.conftest import prose


def corpus(spark, n=600):
    r, rows = random.Random(4), []
    for i in range(n):
        found = prose(1000 + i, 60).split()
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(2):
                found.insert(r.randrange(60), r.choice(["bastardo", "snarkling", "quxter" + r.choice("abc")]))
        rows.append((i, " ".join(found), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["s"] for r in df.select("i", toxicity.score(F.col("text"), model).alias("s")).orderBy("i").collect()]


def test_fold():
    assert toxicity.fold("M0rón, іdiоt!") == " moron idiot "
    assert toxicity.fold("l0ser 1OSER") == " ioser ioser "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_learns_and_finds_disguised_words(spark):
    df = corpus(spark)
    model = toxicity.train(df, df.where("doc_id < 450").select("doc_id", "toxic"))
    seen = df.where("doc_id >= 450").select("toxic", (toxicity.score(F.col("text"), model) >= 0.5).alias("p")).collect()
    assert sum(r["p"] == bool(r["toxic"]) for r in seen) >= 0.98 * len(seen)
    clean = prose(7, 40)
    got = scores(spark, model, [clean + " bastardo snarkling", clean + " Bäst4rdо SNARK1ING", clean, None, "", "\n", prose(8, 30_000)])
    assert got[0] > 0.5 and got[1] > 0.5
    assert got[2] < 0.5 and got[3] == got[4] == got[5] == got[2] and all(0 <= s <= 1 for s in got)


def test_exception_phrases_are_spared(spark):
    df = corpus(spark)
    model = toxicity.train(df, df.select("doc_id", "toxic"), exceptions=("bastardo oil", "snarkling oil"))
    text = prose(9, 40)
    a, b = scores(spark, model, [text + " bastardo oil snarkling oil", text + " bastardo snarkling"])
    assert a < 0.5 < b


def test_labels_of_one_kind_or_none(spark, messy, empty):
    labels = spark.createDataFrame([(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(messy, labels)
    got = messy.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == messy.count() and all(r["s"] < 0.5 for r in got)
    assert toxicity.train(empty, labels).terms == {}
    assert empty.select(toxicity.score(F.col("text"), model)).count() == 0


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
