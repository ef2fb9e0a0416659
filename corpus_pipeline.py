"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and encoding, one after the other.

Each stage is written to the shared folder as Parquet and read again as the documents of the next one, so a lost executor
costs tasks of one stage only. Tables that a stage needs on its way, and its input, are deleted once the stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingolake.llm import bpe, decontaminate, lines, near, quality
from lingolake.sources.store import clear, mark, materialize

STAGES = [
    ("quality_rules", quality.keep_good),
    ("line_dedup", lines.drop_repeated_lines),
    ("near_dedup", near.keep_one),
    ("decontaminate", decontaminate.drop_contaminated),
    ("bpe", bpe.encode_stage),
]

#: The rules of the first stage are learned and the third stage is probabilistic in its candidates; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = mark(spark)
    for name, stage in STAGES[:-1]:
        start = mark(spark)
        result = stage(spark, docs, sf_dir)
        made = mark(spark)
        docs = materialize(result, f"stage-{name}")
        clear(spark, before, start)  # what the stage before left, the stage's input among it
        clear(spark, start, made)  # what this stage needed on its way
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
