"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, tokens.

Each stage reads what its predecessor kept, written as Parquet, and returns the columns of
documents; the last one returns the ids. Near duplicates follow five-word shingles at a
similarity of 0.8. SQL can't express the stages with word vectors, EM or A*, so there is no
SQL for the whole; tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm.common import table, written
from pixelframe.llm.decontaminate import clean_stage
from pixelframe.llm.nbest import encode_stage
from pixelframe.llm.ngram_join import dedup_stage
from pixelframe.llm.pii import redact_stage
from pixelframe.llm.quality_rules import filter_stage

STAGES = [
    ("quality_rules", filter_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("benchmark_decontamination", clean_stage),
    ("pii", redact_stage),
    ("sentencepiece", encode_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
