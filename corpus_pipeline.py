"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. Every stage works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontamination, near_documents, near_lines, packing, quality
from ledgerlark.llm.common import bound_batches, table, written

#: Stages that decide by fitted or hashed models can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose posterior of being good is too low; null texts have no words and fail."""
    bound_batches(spark)
    return quality.judge(docs).filter("_kept").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each line but the first of its near-equal ones; every document stays."""
    bound_batches(spark)
    return near_lines.dedup_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that of least doc_id, linked by shingles of five words; rows without words stay."""
    return near_documents.one_of_each(docs, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text a benchmark item contaminates, rows of equal texts together; null and empty texts stay."""
    bound_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence; a null or empty text is its end id alone."""
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
