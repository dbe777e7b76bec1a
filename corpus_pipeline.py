"""A corpus pipeline: stages that each call one operator of ``verdigris.llm``.

Every stage reads all that its predecessor wrote; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontaminate, mixing, near_dedup, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language.

    Null and empty texts go; a null language, or one with too few labels,
    meets the base rules only.  Repeated rows are judged each, ties of cutoffs
    go to the higher one, and extra columns pass through, whatever their names.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the lowest id.

    Repeated rows stay once.  Texts without words, null ones included, and rows
    with a null id all stay.  Extra columns pass through.
    """
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item.

    Null and empty texts hold none and stay; items without words hit nothing.
    Repeated rows share their fate; extra columns pass through.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it replaced by its kind.

    Every row stays.  Null stays null, a text without spans stays as it is;
    overlapping spans become one, named after the first.  Extra columns pass
    through.
    """
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, with shard, place, copy and taken.

    Of null and empty texts nothing is taken; a null source is the last one.
    Repeated rows are rows like any other.  Columns that were named like the
    four added ones are replaced; others pass through.
    """
    return mixing.materialise(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", personal_data),
    ("mix", mixture),
]

#: Signatures, draws and disclosure thresholds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
