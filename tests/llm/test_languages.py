import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import languages, queries
from tests.llm.conftest import SCHEMA

PARTS = {"aa": "ba be la lo mi", "bb": "trü ßen öch gra zwi", "cc": "ción ñor que los ez", "dd": "ção ões lhe nha em"}


def said(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def table(spark, n=600):
    rows = [(i, said(k := "aabbccdd"[i % 4 * 2 : i % 4 * 2 + 2], i, 3 + i % 50), k) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain(text, longest=3):
    """Counts by the definition, one run at a time."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    out = {}
    for n in range(1, longest + 1):
        for i in range(len(line) - n + 1):
            run = line[i : i + n]
            if run != " ":
                out[run] = out.get(run, 0) + 1
    return out


@pytest.mark.parametrize("slab", [1, 2, 5, 1 << 20])
def test_counts_are_those_of_all_runs(monkeypatch, slab):
    monkeypatch.setattr(languages, "SLAB", slab)
    for text in ("a", "ab", " a  b ", "Añ9b--c d", "word" * 50, "x\n\ny\tz !", "日本 語", said("bb", 1, 30)):
        want = plain(text)
        assert int(languages.counts(text)[1].sum()) == sum(want.values()), text
        alone = sorted(n for n in want.values())
        used, n = languages.counts(text)
        if len(used) == len(want):  # no two runs share a feature
            assert sorted(n.tolist()) == alone
    assert languages.counts(None) is languages.counts("") is languages.counts("12 ?!\n") is None


def test_slabs_do_not_change_counts(monkeypatch):
    text = "Öch gra, zwi!  123 ción " * 40
    used, n = languages.counts(text)
    for slab in (1, 3, 17, 100):
        monkeypatch.setattr(languages, "SLAB", slab)
        got = languages.counts(text)
        assert got[0].tolist() == used.tolist() and got[1].tolist() == n.tolist()


def test_weights_are_sparse_and_follow_the_rule():
    rows = [(np.array([k, 2 + k]), np.array([0.8, 0.6]), k) for k in (0, 1)] * 30 + [(np.array([0, 9]), np.array([1.0, 0.001]), 0)]
    w = languages.follow(rows, 12, 2, passes=3, firm=0.05)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert not w[9].any() and not w[5:9].any()  # too little gradient, or none
    assert not languages.follow(rows, 12, 2, passes=1, firm=1e6).any()
    # One step by hand: p = 1/2 each, so z = x * (p - y) and w = (sign(z) firm - z) / ((beta + |g|) / alpha + ridge).
    one = languages.follow(rows[:1], 12, 2, passes=1, alpha=0.5, beta=1.0, firm=0.1, ridge=0.2)
    assert one[0] == pytest.approx([0.3 / (1.4 / 0.5 + 0.2), -0.3 / (1.4 / 0.5 + 0.2)])


def test_temperature_matches_known_noise():
    r = np.random.default_rng(3)
    true = r.normal(size=(4000, 3)) * 2
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    kinds = np.array([r.choice(3, p=x) for x in p])
    assert languages.fit_temperature(true * 4, kinds) == pytest.approx(4, rel=0.1)


def test_held_out_accuracy_and_calibration(spark, scratch):
    df = table(spark, 1200)
    df.withColumn("source", F.lit("s")).write.parquet(str(scratch / "lang" / "documents.parquet"))
    got = queries.QUERIES["op13_languages"](spark, str(scratch / "lang"))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(df, "doc_id").collect()
    assert len(rows) == 1200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    right = np.mean([r["lang"] == r["lang_pred"] for r in held])
    assert right >= 0.98
    assert abs(right - np.mean([r["score"] for r in held])) < 0.05


def test_predictions_ignore_other_columns(spark, messy):
    model = languages.train(messy.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")))
    get = lambda df: sorted(df.select("text", languages.predicted(F.col("text"), model).alias("p")).distinct().collect(), key=repr)
    assert get(messy) == get(messy.withColumns({"lang": F.lit("q"), "source": F.lit(None).cast("string"), "doc_id": F.lit(-1).cast("long")}))


def test_messy_rows_and_missing_labels(spark, messy, empty):
    model = languages.train(messy)
    got = {(r["doc_id"], r["text"]): r["p"] for r in messy.select("doc_id", "text", languages.predicted(F.col("text"), model).alias("p")).collect()}
    for (_, text), p in got.items():
        none = not text or not any(c.isalpha() for c in text)
        assert (p["lang_pred"], p["score"]) == ("und", 0.0) if none else p["lang_pred"] in ("en", "fr", "xx") and 0 < p["score"] <= 1
    assert languages.train(empty).names == []
    nothing = languages.train(messy.withColumn("lang", F.lit(None).cast("string")))
    assert {r["p"]["lang_pred"] for r in messy.select(languages.predicted(F.col("text"), nothing).alias("p")).collect()} == {"und"}
    single = languages.train(messy.withColumn("lang", F.lit("only")))
    assert {r["p"]["lang_pred"] for r in messy.select(languages.predicted(F.col("text"), single).alias("p")).collect()} == {"und", "only"}
    assert empty.select(languages.predicted(F.col("text"), model)).count() == 0


def test_sample_is_bounded_per_language(spark):
    rows = [(f"text {i}", "hot" if i % 20 else "rare") for i in range(3000)] + [("same", "hot")] * 500
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {r["lang"]: r["count"] for r in languages.sample(df, 60, 1000, 9).groupBy("lang").count().collect()}
    assert 30 <= got["hot"] <= 60 and got["rare"] == 60
    again = sorted(map(tuple, languages.sample(df.repartition(9), 60, 1000, 9).collect()))
    assert again == sorted(map(tuple, languages.sample(df, 60, 1000, 9).collect()))


def test_schema_of_documents(spark):
    df = spark.createDataFrame([(1, said("aa", 1, 5), "aa", None, 3)], SCHEMA)
    assert languages.train(df).names == ["aa"]
