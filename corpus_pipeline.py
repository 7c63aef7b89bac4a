"""From documents to a training mix: a chain of stages, each a table of its own.

Every stage takes all its predecessor kept and applies one operator of levyscape.llm:

1. language     documents whose language is not recognised go
2. lines        lines that earlier documents hold go, and documents that lose all
3. near copies  one document of each group of near-duplicates stays
4. benchmark    documents with a benchmark passage go
5. mix          documents are repeated or left out until the sources have their targets

All but the last return the columns of documents; the last adds `copy`, the number of
the repetition. Null texts and texts without a letter end at the first stage; an empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levyscape.llm import cube, decontaminate, language, line_dedup, simhash
from levyscape.llm.common import stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.learn(docs))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_common_lines(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube.repeat_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_copies", near_copies_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

# trained prototypes, alignments, graph components and random choices: not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix made from documents; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
