import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from episodica.llm import warc


def pages(spark, scratch, name="pages"):
    long, other = "<html>" + "é" * 300, "<p>" + "x" * 200
    rows = [
        (3, "http://a/1", long), (1, "http://a/2", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "v", None), (7, "v", ""),
        (8, "w", other), (None, "w", other), (9, "w x\r\ny", "z" * 100), (10, "w", "z" * 100), (11, "w", "z" * 99), (12, "w", "z" * 99),
        (13, "dup", other + "!"), (13, "dup", other + "!"), (None, None, "<b>" + "\r\n\r\n" * 80), (14, "big", "y" * 3_000_000), (15, "nul", "\x00" * 120),
    ]
    path = str(scratch / f"{name}.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as row", "'own' as payload").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip(spark, scratch):
    df = pages(spark, scratch)
    index, folder = warc.write(df)
    out = warc.read(index, folder, with_payload=True).collect()
    rows = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in df.collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in out) == Counter((p, len(h), hashlib.sha256(h).hexdigest()) for p, _, h in rows)
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h, []).append(p)
    for h, ids in groups.items():
        got = [r for r in out if r["payload_digest"] == hashlib.sha256(h).hexdigest()]
        heads = [r for r in got if r["record_type"] == "response"]
        if len(h) < warc.LEAST_PAYLOAD:
            assert len(heads) == len(ids) and all(r["refers_to"] is None for r in got)
            continue
        least = min((i for i in ids if i is not None), default=None)
        assert [r["page_id"] for r in heads] == [least] and heads[0]["refers_to"] is None
        assert all(r["refers_to"] == least for r in got if r["record_type"] == "revisit")
    assert all(bytes(r["payload"]) in groups for r in out if r["record_type"] == "response")


def test_archives_are_plain_warc(spark, scratch):
    index, folder = warc.write(spark.read.parquet(str(scratch / "pages.parquet")), file_bytes=500)
    rows = index.collect()
    assert len({r["file"] for r in rows}) > 3  # files roll
    for r in rows:
        with open(f"{folder.removeprefix('file://')}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            fields, payload = warc.parse(gzip.decompress(f.read(r["length"])))
        assert fields["WARC-Payload-Digest"] == f"sha256:{r['payload_digest']}"
        assert r["record_type"] == "revisit" or len(payload) == r["payload_bytes"]


def test_selected_records_are_read_in_ranges(spark, scratch):
    index, folder = warc.write(spark.read.parquet(str(scratch / "pages.parquet")))
    spans = warc.ranges(index).groupBy("file", "span").count().count()
    assert spans < index.count()
    got = warc.read(index, folder, F.col("page_id").isin(1, 14)).collect()
    assert sorted(r["page_id"] for r in got) == [1, 14]


def test_no_pages(spark, scratch):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index, folder = warc.write(df)
    assert index.count() == 0 and warc.read(index, folder).count() == 0


def test_readers_grow_with_the_bytes_of_the_archives(spark, scratch, monkeypatch):
    index, folder = warc.write(pages(spark, scratch, "readers"))
    tasks = lambda: warc.read(index, folder).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks() == 1
    monkeypatch.setattr(warc, "RANGE_BYTES", 400)
    assert tasks() > 2
    assert sorted(r["page_id"] or 0 for r in warc.read(index, folder).collect()) == sorted(r["page_id"] or 0 for r in index.collect())
