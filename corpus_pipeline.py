"""The corpus pipeline: stages over ``documents``, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, line_spread, parity_join, quality_rules
from millrace.llm.queries import piece_digests, table
from millrace.sources.scratch import cut_lineage, free_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    forest = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, forest)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share."""
    return line_spread.remove_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return parity_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document left, and of what they decode to."""
    return piece_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: No SQL has the trees or the segmentation of the model; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            free_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
