"""One query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import conversations, jaccard, languages, licences, mixing, neighbours, packing, quality, resampling, sharding, tokens, toxicity, warc
from episodica.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARDS = 40
TOKEN_LIMIT = 512
END_ID = 2


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(spark, folder.rstrip("/"))
        if sql:
            SQL[name] = sql
        return build

    return register


@query("op1_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards; counts differ by one row at most."""
    rows, _ = sharding.shard_rows(sharding.digests(table(spark, folder, "documents")), ["doc_id", "text_crc32", "size"], SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every whole text, and whether base rules and proven cutoffs keep it."""
    docs = quality.measured(table(spark, folder, "documents"))
    docs = quality.durable(docs)
    chosen = quality.choose(quality.labelled_counts(docs, table(spark, folder, "labels")))
    c = F.col("counts")
    return docs.select(
        "doc_id", *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality.base_failed(c).alias("base_failed"), quality.verdict(quality.stratum(F.col("lang")), chosen).alias("kept"),
    )


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every whole text, learned without the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are 0.9 alike or more."""
    return jaccard.linked(table(spark, folder, "documents"), 3, 90)


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Block, slot and place of all documents in a mix by the square root of source sizes."""
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source"))


@query("op5_warc")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    index, archives = warc.write(table(spark, folder, "pages"))
    return warc.read(index, archives).drop("url")


@query("op9_neighbours")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every 100th one."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_licences")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families that the lines of every document name."""
    return licences.licences(table(spark, folder, "documents"))


@query("op11_conversations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged in known ways, then repaired by the cheapest edits."""
    turns = table(spark, folder, "conversations")
    return conversations.with_lost(conversations.report(conversations.damaged(turns)), turns)


@query("op12_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document weighed by its likeness to the benchmark; a tenth of those of 20 words or more is drawn."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_languages")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text, learned without the held-out fold."""
    docs = table(spark, folder, "documents")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = languages.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), languages.predicted(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")
