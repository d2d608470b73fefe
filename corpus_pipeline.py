"""A training corpus from raw documents in five stages, each over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the next one's docs. The order of the
mix is the order of the files and rows that stage ``mixing`` writes; ``packing`` reads it back from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality_model, quality_rules, simhash
from tidemark.llm.common import shared_dir
from tidemark.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others keep their text as it is."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.in_mixed_order(docs, mixing.root_weights(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, documents in the order in which they were written."""
    return packing.pack(docs, tokenizer_path(), by_file=True)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", line_rules), ("simhash", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: The classifier and the fingerprints can't be expressed in SQL. Tests compare near-duplicates and mixing with plain versions; the pipeline as a whole and the classifier have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tidemark-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
