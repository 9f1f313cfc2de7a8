"""The training-data pipeline: quality filter, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``documents``. A
stage's result is written as Parquet and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.chosen_path import near_dedup_stage
from gradeloom.llm.common import written
from gradeloom.llm.exact_dedup import exact_dedup_stage
from gradeloom.llm.mixing import mixing_stage
from gradeloom.llm.quality import quality_stage
from gradeloom.llm.sentence_piece import encode_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encode_stage),
]

# The classifier can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
