"""A training-data pipeline over the documents table, stage by stage.

Toxic documents go, one document of each near-duplicate class stays, documents that
hold benchmark items go, secrets are replaced by a mark, and what is left is mixed to
target weights into training blocks.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra
columns and empty tables.  A null or empty text has no word that is scored, shares the
fingerprint of all such texts (one row of them stays), holds no item and no secret, and
gives the mix nothing.  A null id comes last where the least id stays.  An empty table
goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, mixing, secrets, simhash, toxicity
from ledgerloom.llm.common import read, scratch
from ledgerloom.session import fresh_path


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the toxicity score does not reject."""
    labels = read(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, labels.filter(~toxicity.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints are linked within two bits."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, their secrets replaced by a mark."""
    return secrets.redact(docs, length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training blocks of the mix: one row per piece of a document in a slot."""
    rows = mixing.packed(docs)
    plan = mixing.quotas(mixing.source_sizes(rows))
    return mixing.mix(rows, plan, with_text=True)


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_strings),
    ("mixing", mixture),
]

#: The stages score by trained models, hash shingles by XXH64 and draw by seed, which
#: DuckDB cannot restate; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written rows of the one before.

    The tables that a stage writes on its way go when its own rows are written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
