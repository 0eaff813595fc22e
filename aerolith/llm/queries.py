"""The operators' queries over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import ann, fertility, fm_dedup, lang_id, minhash, mixing, packing, suffix_dedup, url_filter, warc
from aerolith.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.query(table(spark, sf_dir, "documents"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.query(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.query(table(spark, sf_dir, "embeddings"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(table(spark, sf_dir, "documents"))


def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.query(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(spark, sf_dir)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op5_curriculum_mix": mixing.ORACLE, "op10_url_filter": url_filter.ORACLE}
