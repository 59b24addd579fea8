"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import (
    additive,
    collocations,
    jaccard,
    lexical,
    mixing,
    packing,
    quality_rules,
    resampling,
    secrets,
    substring_dedup,
    suffix_dedup,
    toxicity,
    urls,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: documents that are not kept give no row."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_nearest,
        op3_suffix_dedup,
        op4_quality_rules,
        op5_toxicity,
        op6_substring_dedup,
        op7_mixing,
        op8_packing,
        op9_jaccard_join,
        op10_quality_classifier,
        op11_collocations,
        op12_lexical_search,
        op13_url_filter,
    )
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_url_filter": urls.ORACLE_SQL,
}
