"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.staging import drop, staged


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b).

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones; the number of rounds grows with the
    logarithm of the component's size. Only minima meet in aggregations; round tables lie in the shared folder.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b")))
        after = staged(star.distinct(), "edges")
        drop(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
    out._staged_at = now._staged_at  # drop(out) removes the last table
    return out


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
