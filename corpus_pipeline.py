"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of docs. Documents of null text count as empty: quality rejects them. Empty
input gives empty output with the last stage's columns; repeated rows end as one in the
near-duplicate stage; columns beyond those of documents ride along untouched up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.llm import common, near_copies, op02_quality, op06_packing, op07_simhash, op08_toxicity, op10_pii


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by their nearest labelled examples."""
    index = op08_toxicity.fit_on(docs, common.table(spark, sf_dir, "labels"))
    return op08_toxicity.toxicity(docs, index).filter("tox_predicted = 0").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are outliers of their language and source."""
    return op02_quality.quality(docs, keep=tuple(docs.columns)).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (5-word Jaccard 0.8 or more) stays: the one
    of least doc_id."""
    return op07_simhash.keep_one(docs, near_copies.near_components(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]; n_chars follows the text."""
    marked = op10_pii.with_spans(docs.select(F.struct(*docs.columns).alias("d"), F.col("text").alias("t")), "t", "pii")
    text = common.let(common.text_of("t"), lambda t: common.let(F.col("pii"), lambda p: op10_pii.redact(t, p)))
    clean = marked.select("d", F.when(F.col("t").isNotNull(), text).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*[new.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequence and offset."""
    return op06_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL can't express nearest neighbours under a bound, covariance steps or column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with common.scratch(spark) as keep:  # a stage leaves its result only
            before, docs = docs, keep(common.materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if i:
            common.drop_materialized(before)
    return STAGES[-1][1](spark, docs, sf_dir)
