"""Queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations, hard_negatives, image_match, license_scan, lm, mixing, packing, personal_data, quality_model, quality_rules, simhash, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a media column drawn from the vectors of embeddings, as no table has images."""
    return image_match.find_copies(image_match.media(table(spark, sf_dir, "embeddings")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.root_weights(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_zip": op2_warc_zip,
    "op3_license_scan": op3_license_scan,
    "op4_image_copies": op4_image_copies,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_collocations": op11_collocations,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op1_quality_rules": quality_rules.ORACLE, "op2_warc_zip": warc.ORACLE, "op3_license_scan": license_scan.oracle(), "op11_collocations": collocations.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
