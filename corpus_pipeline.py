"""The corpus pipeline: documents to packed sequences, through five stages of vellum.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes every stage's result as Parquet in the shared folder and reads it back for the next, so a lost
executor costs a task and not the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import toxicity
from vellum.llm.decontaminate import decontaminated
from vellum.llm.near_dup import deduplicated
from vellum.llm.packing import pack
from vellum.llm.secret_scan import without_secrets
from vellum.llm.shared import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7, by a model of the labelled ones."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group by 5-word shingles at a similarity of 0.8: the one of the least doc_id."""
    return deduplicated(docs, words=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret."""
    return without_secrets(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op4 returns them."""
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", drop_secrets),
    ("packing", pack_tokens),
]

#: SQL can't express the learned scores or the tokenizer; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
