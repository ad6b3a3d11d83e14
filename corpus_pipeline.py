"""From raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and gives back a DataFrame, which is
written and read again as the next one's docs. All but the last give back the
columns of ``documents``; the last adds ``shard`` and ``slot``.

Nulls, empty and long texts, ties, repeated rows and empty tables have the
results that the operators' modules state; columns beside the known ones pass
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm import quality
from accesslens.llm.chosen_path import PathConfig, one_of_each
from accesslens.llm.common import table, written
from accesslens.llm.decontam import decontaminate
from accesslens.llm.hilbert import hilbert_shards
from accesslens.llm.mixing import mixed

#: Near duplicates share four fifths of their shingles of five words.
NEAR = PathConfig(percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, gives a probability of at least one half."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), quality.held_out_column()))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it; where a column has such a name already, ours get a longer one."""
    placed = hilbert_shards(docs)
    taken = {c.lower() for c in docs.columns}
    ours = []
    for name in ("shard", "slot"):
        new = name
        while new in taken:
            new += "_"
        ours.append(F.col(name).alias(new))
    return placed.select(*[placed["row"][c].alias(c) for c in docs.columns], *ours)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier's decisions cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
