"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; all
but the last return the columns of ``documents``. Every stage is written to the
shared folder and read again, so a later stage never repeats an earlier one; what
the stage before wrote is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daygraph.llm.decontaminate import keep_clean
from daygraph.llm.mixing import mix_documents
from daygraph.llm.pii import mask
from daygraph.llm.quality_rules import keep_good
from daygraph.llm.set_join import keep_one
from daygraph.session import discard, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the verdict on their host reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; no document goes."""
    return mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of copies it takes."""
    return mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Set similarity and draws are beyond SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
