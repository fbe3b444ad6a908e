"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model may learn labels from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 7) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled documents outside the held-out fold, by seeded hash of doc_id.

    Of several labels of one id the largest counts. Only ids and labels are ranked; the texts follow by a
    broadcast of the ids, whose number is bounded.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
