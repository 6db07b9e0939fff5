"""From raw documents to packed sequences, as stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet and read again as the next stage's docs.

For all stages: nulls in any column are allowed (a null text counts as empty, a null
source or language is one of its own, a null id is no id), texts are read whole, ties
are broken by values and not by place, repeated rows are decided each (the near
duplicates keep one), empty tables give empty tables, and further columns, whatever
their names, come back with their values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, packing, quality, simhash, toxicity
from tracewright.llm.common import quoted, settle, table
from tracewright.llm.queries import CAPACITY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents scored as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by fingerprints."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each copy that is taken."""
    mixed = mixing.mix(docs, added=None)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*[quoted(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
