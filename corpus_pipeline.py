"""A training corpus from ``documents``: five stages, each by its operator.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame; ``run`` writes each as Parquet into the shared
folder and rereads it as the next one's ``docs``.  All stages but the last
return the columns of ``documents``.  Nulls, empty texts, repeated rows, extra
columns and empty tables behave as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, quality, simhash, toxicity
from quire.llm.common import held_out, read, shared_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go.  The model learns from
    the labelled documents of the table, as in the operator's own query."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                         train=~held_out(F.col("doc_id"), 5, 0))
    return toxicity.without_toxic(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined views score below 0.5 go."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                        train=~held_out(F.col("doc_id"), 5, 0))
    return quality.good_documents(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (3-word shingles, at most 2 differing
    bits) the document with the smallest id stays."""
    return simhash.one_of_each(docs, shingle=3, bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, decontaminate.blocks(read(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with ``size``, ``source_size``,
    ``target``, ``taken`` (words, repeats counted) and the ``shards`` that get a
    copy, in the order of the copies.  Documents that it doesn't take aren't in it."""
    mixed = mixing.mix(docs)
    own = ["size", "source_size", "target", "taken", "shards"]
    return (mixed.where(F.size("mix.copies") > 0)
            .select(*[F.col(f"`{c}`") for c in docs.columns if c not in own],
                    "mix.size", "mix.source_size", "mix.target", "mix.taken", F.col("mix.copies.shard").alias("shards")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# SQL can't express the stages (trained models, SimHash, q-gram alignment,
# hypergeometric draws): tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
    return docs
