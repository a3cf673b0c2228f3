"""From raw documents to packed sequences, in five stages.

Each stage gets what the one before it kept, as a table; all but the last return the
columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import jaccard, mixing, packing, quality, toxicity
from episodica.llm.common import session, table
from episodica.session import cuts, drop_cuts, durable

NEAR_WORDS, NEAR_PERCENT = 5, 80
TOXIC = 0.5
END_ID = 2


_left: list[str] = []  # tables that earlier stages have cut their lineage with


def stage(step):
    """``step``, after the scratch tables of the stages before it are gone: their results are written by then."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session(spark)
        _left[:] = drop_cuts(spark, _left, docs)
        with cuts() as made:
            out = step(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_step


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` has no column of."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; null and empty texts score as clean."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    own = unused(docs, "toxicity")
    return docs.withColumn(own, toxicity.score(F.col("text"), model)).where(F.col(own) < TOXIC).drop(own)


@stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the proven cutoffs let pass; empty ones do not."""
    own = unused(docs, "counts")
    measured = durable(docs.withColumn(own, quality.counts(F.col("text"))))
    counted = measured.select("doc_id", "lang", F.col(own).alias("counts"))
    chosen = quality.choose(quality.labelled_counts(counted, table(spark, sf_dir, "labels")))
    keep = quality.verdict(quality.stratum(F.col("lang")), chosen, own)
    return measured.where(F.coalesce(keep, F.lit(False))).drop(own)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of smallest doc_id."""
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that mixes sources to their target weights."""
    return mixing.mixed_order(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, numbered in the order of the mix."""
    return packing.pack(packing.in_written_order(docs), public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Learned weights, proven cutoffs and tokenizers are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for _, step in STAGES[:-1]:
        docs = durable(step(spark, docs, sf_dir.rstrip("/")))
    return STAGES[-1][1](spark, docs, sf_dir.rstrip("/"))
