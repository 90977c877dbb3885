"""The training-data pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
documents. Every result is written as Parquet and reread before the next stage. Null texts and ids, repeated rows, empty
tables and further columns are treated as the operators that the stages call say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontaminate, linededup, packing, simhash, toxicity
from rillflow.llm.common import cut, drop_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that toxicity rejects; null and empty texts stay, other columns aren't read."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with one occurrence of each group of like lines; n_chars counts what is left (null for a null text)."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without a word form one group."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; rows without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: one row each; a null or empty text has one piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the trained model, the components or the packing; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = written()
        docs = cut(stage(spark, docs, sf_dir))
        drop_written(spark, [*before, docs._cut_path])
    return STAGES[-1][1](spark, docs, sf_dir)
