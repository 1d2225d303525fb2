"""Documents to training tokens: quality rules, dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendscope.llm.common import materialize, table
from lendscope.llm.mixing import mixing_stage
from lendscope.llm.mph_dedup import dedup_stage
from lendscope.llm.parity_join import near_dedup_stage
from lendscope.llm.quality import quality_stage
from lendscope.llm.spm import encoding_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("exact dedup", dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("encoding", encoding_stage),
]

# Seeded samples, thresholds from binomial tails and merges are not SQL; tests/llm holds the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
