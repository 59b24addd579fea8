"""Training-corpus pipeline over `documents`: reject poor texts, keep one of each near-duplicate group,
mask secrets, mix the sources to their weights, pack into sequences.

Every stage is a function of (spark, docs, sf_dir); its result is written and reread as the next one's
input. All but the last return the columns of `documents`, further ones included.

Rows without an id pass every stage by themselves: the classifier weighs them by their text, they link to
nothing and stay, and they are scanned, mixed and packed as any row. Null and empty texts have weight 0,
link to nothing, hold no secret and have no word to take, so the mix leaves them out. Repeated rows are
kept or rejected together, then one of them stays. An empty table gives an empty result. Names of
further columns never clash with those made inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import jaccard, mixing, packing, resampling, secrets
from rasterloom.llm.base import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return resampling.keep_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and 0.8."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, one of each source in part."""
    return mixing.materialise_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
#: SQL cannot express the classifier, the tokenizer or the packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
