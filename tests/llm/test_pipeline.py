import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from episodica.llm import quality
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute
from tests.llm.test_quality import brute as measured

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


def test_stages_over_the_small_table(spark):
    """Each stage against what brute force says about its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept, tables = docs.columns, docs, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = corpus_pipeline.durable(stage(spark, kept, SMALL))
        assert kept.columns == columns
        tables.append(kept)
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    # Quality: base rules hold exactly.
    rows = tables[1].select("doc_id", "text").collect()
    passed = {r["doc_id"] for r in rows if (m := measured(r["text"]))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    assert set(ids[2]) <= passed
    # Near copies: one of each group, that of smallest id.
    groups = brute([(r["doc_id"], r["text"]) for r in tables[2].select("doc_id", "text").collect()], 5, 80)
    assert ids[3] == sorted({c for _, _, c in groups})
    assert ids[4] == ids[3]
    # Packing: every token once.
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    code = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(code.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept.select("doc_id", "text").collect()}
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want


def test_sequences_follow_the_mix(spark, scratch, monkeypatch):
    """Shares of sources by sequence_id, over several files whose sizes are not in order."""
    # Small sequences, so that there are many windows; many part files.
    real, least = corpus_pipeline.packing.pack, "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, end: real(docs, path, end, 16))
    rows = [(i, prose(i, 20), "hot", 0) for i in range(3000)] + [(i, prose(i, 5), "bc"[i % 2], 0) for i in range(3000, 3600)]
    path, stages = str(scratch / "order.parquet"), dict(corpus_pipeline.STAGES)
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").write.parquet(path)
    before = spark.conf.get(least)
    spark.conf.set(least, "1KB")
    try:
        mixed = corpus_pipeline.durable(stages["mixing"](spark, spark.read.parquet(path), SMALL))
        assert len(mixed.inputFiles()) > 3
        pieces = stages["packing"](spark, mixed, SMALL).collect()
    finally:
        spark.conf.set(least, before)
    first, most = {}, 0
    for p in pieces:
        first[p["doc_id"]] = min(p["sequence_id"], first.get(p["doc_id"], p["sequence_id"]))
    assert len(first) == 3600
    weights = {"hot": 3000**0.5, "b": 300**0.5, "c": 300**0.5}
    source, done = {i: s for i, _, s, _ in rows}, dict.fromkeys(weights, 0)
    for t, doc in enumerate(sorted(first, key=lambda d: (first[d], d)), 1):
        done[source[doc]] += 1
        if t <= 1500:  # up to here all sources have documents left
            most = max(most, *[abs(done[s] - w * t / sum(weights.values())) for s, w in weights.items()])
    assert most < 2 * 32 + 130  # two blocks, and the documents of one window


def test_messy_documents(spark, messy, empty, scratch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    folder = str(scratch / "messy-run")
    labels.write.parquet(f"{folder}/labels.parquet")
    for name, docs in (("messy", messy), ("empty", empty)):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.durable(stage(spark, kept, folder))
            assert kept.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
        assert out.columns == [f.split()[0] for f in corpus_pipeline.packing.FIELDS.split(", ")]
        assert (out.count() > 0) == (name == "messy")
        bad = quality.measured(kept).where(quality.base_failed(quality.F.col("counts"))).count()
        assert bad == 0
