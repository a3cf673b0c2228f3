import re
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import functions as F

from episodica.llm import quality
from tests.llm.conftest import prose


def brute(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_are_those_of_brute_force():
    texts = [
        None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b c d e f a b c d e", "x\nx\n \nx\r\nx\n", "# * $%&|<>", "  a b \x1c",
        "a b c d e a b c d e a b c d e", prose(1, 120), prose(1, 20) + " " + prose(2, 5) + " " + prose(1, 20), "é " * 30, "THE END IS",
    ]
    for text in texts:
        assert quality.measure(text)[:5] == brute(text), text


def test_repeats_of_random_words():
    r = np.random.default_rng(1)
    for n in (0, 4, 5, 6, 30, 200):
        ids = r.integers(0, 3, n)
        text = " ".join(map(str, ids))
        assert quality.repeated_words(ids.astype(np.int64)) == brute(text)[4]


def test_tail_is_exact():
    for n, seen, share in ((10, 0, 0.1), (50, 3, 0.02), (2000, 1, 0.002)):
        p = Fraction(share)
        want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(seen + 1))
        assert abs(quality.tail(seen, n, share) - float(want)) < 1e-9


def labelled(spark, rows):
    names = [f.split()[0] for f in quality.COUNTS.split(", ")]
    return spark.createDataFrame(rows, f"stratum string, quality int, counts struct<{', '.join(n + ':long' for n in names)}>")


def test_copies_prove_nothing(spark):
    one = (100, 500, 0, 0, 0, 10, 0)
    assert quality.choose(labelled(spark, [("en", 1, one)] * 5000)) == {"en": {}}


def test_ids_labelled_both_ways_are_not_used(spark):
    docs = quality.measured(spark.createDataFrame([(i, prose(i, 20), "en") for i in range(3)], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 0), (2, None), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.labelled_counts(docs, labels).select("doc_id", "quality").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (2, 0)]


def test_cutoffs_keep_the_guarantee(spark):
    symbols = lambda i: (100, 500 + i, 45, 0, 0, 10, 0)
    clean = lambda i: (100, 200 + i % 300, 0, 0, 0, 10 + i // 300, 0)
    rows = [("en", 1, clean(i)) for i in range(5000)] + [("en", 1, symbols(i)) for i in range(40)]
    rows += [("fr", 1, clean(i)) for i in range(100)] + [("en", 0, symbols(i)) for i in range(500)]
    chosen = quality.choose(labelled(spark, rows))
    # 40 of 5040 good rows have a share of 0.45: no cutoff below that can be proven, 0.5 can.
    assert chosen["en"]["symbols"] == 0.5
    assert chosen["en"]["dup_lines"] == quality.CUTOFFS["dup_lines"][-1]
    assert chosen["fr"] == {}  # too few rows to prove anything
    more = quality.choose(labelled(spark, rows + [("en", 1, clean(5000 + i)) for i in range(60_000)]))
    assert more["en"]["symbols"] < 0.45


def test_messy_rows(messy, empty, spark):
    docs = quality.measured(messy)
    c = F.col("counts")
    out = docs.select("doc_id", c["n_words"].alias("n"), quality.base_failed(c).alias("bad"), quality.verdict(quality.stratum(F.col("lang")), {}).alias("kept"))
    texts = messy.select("text").collect()
    want = sorted((brute(r["text"])[0] for r in texts))
    got = out.collect()
    assert sorted(r["n"] for r in got) == want
    assert all(r["kept"] == (not r["bad"]) for r in got)
    assert all(r["bad"] for r in got if r["n"] < 10)
    labels = spark.createDataFrame([(0, 1), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    assert quality.choose(quality.labelled_counts(docs, labels)) is not None
    assert quality.measured(empty).count() == 0
    assert quality.choose(quality.labelled_counts(quality.measured(empty), labels)) == {}
