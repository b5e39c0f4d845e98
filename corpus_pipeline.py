"""The corpus pipeline: five stages, each a DataFrame of documents to the next; the last one returns the packed batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from casewright.llm.common import scratch, shared_dir

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("exact_dedup", exact_dedup.exact_dedup_stage),
    ("near_dedup", near_dedup.near_dedup_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]
#: Learnt scores are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each result as Parquet and reading it again.

    What a stage staged for itself is deleted once its result is written; the stages' results stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        with scratch(spark):
            step(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
