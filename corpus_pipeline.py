"""From raw documents to packed training sequences, stage by stage.

Each stage is one operator of ``codeloom.llm`` whose decisions take effect on
what the stage before it kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import stages
from codeloom.llm.common import stage, table

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near-duplicate removal", stages.near_duplicate_removal),
    ("benchmark decontamination", stages.benchmark_decontamination),
    ("secret redaction", stages.secret_redaction),
    ("best-fit packing", stages.best_fit_packing),
]

# Token ids, sketches and edit distances are not SQL; tests hold the rows
# against brute-force versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES[:-1]):
        docs = stage(function(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
