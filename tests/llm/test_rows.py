"""Rows keep their numbers where later scans of the same files are split in other ways."""

from collections import Counter

import pytest

from episodica.llm import common, jaccard, mixing, warc
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute

SPLITS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]


@pytest.fixture
def moving(spark, monkeypatch):
    """After each table that is written, files are split in another way."""
    before, calls = {k: spark.conf.get(k) for k in SPLITS}, [0]
    real = common.durable

    def durable(df):
        out = real(df)
        calls[0] += 1
        for k in SPLITS:
            spark.conf.set(k, str(300 + 150 * (calls[0] % 7)))
        return out

    for module in (common, mixing, jaccard, warc):
        monkeypatch.setattr(module, "durable", durable)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def docs(spark, scratch):
    texts = [prose(i, 25) for i in range(30)]
    rows = [(i, texts[i % 30] if i % 3 else texts[i % 30] + " more", "abc"[i % 3]) for i in range(60)]
    path = str(scratch / "moving.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).write.parquet(path)
    return spark.read.parquet(path)


def test_mixed_order(docs, moving):
    want = Counter(map(tuple, docs.collect()))
    assert Counter(map(tuple, mixing.mixed_order(docs).collect())) == want


def test_groups_and_one_of_each(docs, moving):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 80)
    assert sorted(map(tuple, jaccard.linked(docs, 3, 80).collect())) == sorted(want)
    kept = jaccard.one_of_each(docs, 3, 80).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in want})


def test_archives(spark, docs, moving):
    pages = docs.selectExpr("doc_id % 30 as page_id", "'u' as url", "repeat(source, 400) as html")
    index, folder = warc.write(pages)
    got = warc.read(index, folder, with_payload=True).collect()
    assert len(got) == 60
    assert Counter(r["record_type"] for r in got) == {"response": 3, "revisit": 57}
    assert all(r["refers_to"] is not None for r in got if r["record_type"] == "revisit")
