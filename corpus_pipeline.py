"""A corpus pipeline: toxicity, near duplicates, secrets, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is written as Parquet and read again as the next one's docs.

Edge cases: a null or empty text has the toxicity of no words, is no near duplicate of anything, has no secrets, and the mix
takes nothing of it; a null doc_id is a document of its own that has no near duplicates; a null source is a source; rows
that are equal in all columns are near duplicates of each other; different texts of one doc_id are documents of their
own; of equals the row that stays is stated in without_near_duplicates(); texts of any length are read whole; an empty
table gives no rows at any stage; other columns of documents, whatever their names, pass through all stages but the
last, which returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import jaccard, mixing, packing, secrets, toxicity
from ruleloom.llm.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least doc_id, and all that have no words or no doc_id."""
    return jaccard.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets, of any length, replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them whole, and a row for each run of words that its seeded blocks take once more."""
    return mixing.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix, with its length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL can express neither the fitted machine nor the seeded selection of blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
