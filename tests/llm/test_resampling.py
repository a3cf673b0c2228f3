import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from episodica.llm import queries, resampling
from tests.llm.conftest import SCHEMA, messy_rows, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def runs(text, longest):
    words = WORD.findall(lower(text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, k=10_000, percent=10, least=20, seed=2024):
    def counted(texts):
        out = [0] * k
        for t in texts:
            for f in runs(t, longest)[1]:
                out[zlib.crc32(f.encode("utf-8", "surrogatepass")) % k] += 1
        return out

    s, t = counted([d[1] for d in docs]), counted(target)
    total_s, total_t, rows = sum(s), sum(t), []
    for doc_id, text in docs:
        words, features = runs(text, longest)
        at = [zlib.crc32(f.encode("utf-8", "surrogatepass")) % k for f in features]
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + k) / ((s[b] + 1) * (total_t + k)))) for b in at]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(features), weight, score, len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return rows, able[: percent * len(able) // 100]


def same(got, docs, target, **how):
    rows, drawn = brute(docs, target, **how)
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, (r[:4] for r in rows)))
    ranked = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
    assert [g[4] for g in ranked] == list(range(1, len(drawn) + 1))
    assert [g[:4] for g in ranked] == [r[:4] for r in drawn]


def test_crcs_of_all_lengths():
    r = random.Random(1)
    some = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 511, 512, 513, 5000] for _ in range(3)]
    r.shuffle(some)
    assert resampling.crc32s(some).tolist() == [zlib.crc32(x) for x in some]
    assert resampling.crc32s([]).tolist() == []


def test_slabs_hold_the_same_features(monkeypatch):
    text = prose(3, 200) + "  É1-x_y\tÀ" + "long" * 40
    want = {n: sorted(x.encode() for x in runs(text, n)[1]) for n in (1, 2, 3)}
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(resampling, "SLAB", size)
        for n in (1, 2, 3):
            slabs = list(resampling.feature_slabs(text, n))
            assert sorted(f for _, fs in slabs for f in fs) == want[n]
            assert sum(w for w, _ in slabs) == len(want[1])


@pytest.mark.parametrize("longest", [1, 2])
def test_messy_rows(spark, messy, longest):
    target = [prose(2, 80), None, "", prose(5, 30), "x y z"]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(messy, df, longest=longest, buckets=997, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got, [r[:2] for r in messy_rows()], target, longest=longest, k=997, percent=40)


def test_likeness_decides(spark):
    r, own = random.Random(3), prose(7, 50).split()
    text = lambda: " ".join(r.choice(own) for _ in range(60))
    df = spark.createDataFrame([(i, text()) for i in range(40)] + [(100 + i, prose(50 + i, 60)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(),) for _ in range(200)], "text string")
    got = resampling.resample(df, target).where("rank is not null").collect()
    assert len(got) == 44 and sum(r["doc_id"] < 40 for r in got) > 14  # 4 would come without weights


def test_empty_tables(spark, messy, empty):
    assert resampling.resample(empty, empty).count() == 0
    none = resampling.resample(messy, empty, buckets=50)
    same(none, [r[:2] for r in messy_rows()], [], k=50)


def test_query_is_brute_force(spark, scratch):
    rows = messy_rows() + [(1000 + i, prose(i, 5 + i % 40), "en", "s", 1) for i in range(400)] + [(1000, prose(0, 50), "en", "s", 1)]
    target = [prose(i, 20) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(scratch / "draw" / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(str(scratch / "draw" / "benchmark.parquet"))
    got = queries.QUERIES["op12_resampling"](spark, str(scratch / "draw"))
    assert all(t == "bigint" for _, t in got.dtypes)
    same(got, [r[:2] for r in rows], target)


def test_noise_is_one_draw_per_id(spark):
    got = spark.range(200).select(resampling.noise(F.col("id")).alias("n")).collect()
    assert len({r["n"] for r in got}) > 150
