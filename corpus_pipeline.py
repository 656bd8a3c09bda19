"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns a DataFrame; ``run`` writes each as Parquet in the shared
folder and rereads it as the next one's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import exact_dedup, packing, pii, simhash, toxicity
from scholium.llm.common import table, written

#: The stages fit a model and follow links between documents, which SQL can't express: tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity grade is likelier 1 or more go."""
    return toxicity.rejected_removed(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays."""
    return simhash.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, and terms that disclose it are generalised or removed."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their sequence and place."""
    return packing.pack_documents(docs, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
