"""The corpus pipeline: language, toxicity, near-duplicates, repeated passages, packing.

Each stage gets what the one before has kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeward.llm.common import reread, shared_folder, table
from lakeward.llm.language import language_stage
from lakeward.llm.packing import packing_stage
from lakeward.llm.simhash import simhash_stage
from lakeward.llm.substrings import substring_stage
from lakeward.llm.toxicity import toxicity_stage

STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Learned filters, linked fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows are the pieces of packed sequences."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
