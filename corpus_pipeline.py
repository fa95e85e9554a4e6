"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage takes what its predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.linededup import dedup_lines
from quern.llm.neardup import drop_near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.robust import quality_rules
from quern.llm.secretscan import redact_secrets
from quern.session import ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits or the robust estimates reject go."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first stays; documents that lose all their lines go."""
    ship(spark)
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked from a similarity of 0.8 on, one document stays."""
    ship(spark)
    return drop_near_duplicates(docs, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind."""
    ship(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens in sequences of the permitted lengths."""
    import public_tokenizers

    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs


ORACLE_SQL = None
