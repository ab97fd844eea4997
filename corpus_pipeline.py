"""A training-data pipeline over ``documents``: language, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages before the last return the columns
of ``documents``; the last returns tokens. ``run`` writes every stage as Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import bpe, common, fmindex, langid, parity, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language has a lower mean probability than this are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognizable language; ``lang`` becomes the predicted one."""
    spark.conf.set("parquet.block.size", str(common.ROW_GROUP))  # whoever writes the stages, a task holds a small row group
    return langid.relabelled(docs, LEAST_SCORE).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return parity.survivors(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark; documents that consist of nothing else go."""
    return fmindex.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found."""
    return pii.mask(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: The network and the merge queue cannot be stated in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
