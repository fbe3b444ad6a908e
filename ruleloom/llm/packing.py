"""Packing documents into padded batches with optimal length buckets.

The lengths (words) of all documents make one histogram: a count for each length up to EXACT, and above it for
each of 1024 steps between powers of two, so its size is bounded whatever the corpus. Dynamic programming over
it chooses at most BUCKETS upper bounds with the least padding in all (each document is padded to its bucket's
bound). Inside a bucket, batches hold as many documents as the token budget allows at the padded length, and
one at least.

A bucket's documents are dealt to shards of about SHARD by a seeded hash of id and text, so a bucket that holds most
of the corpus is numbered by many tasks; each shard has one batch that may not be full. Same rows, parameters and
seed: same batches.

Edge cases: null text has length 0; documents of length 0 are packed as the others; a document longer than the
budget is a batch by itself; texts of any length are counted whole; repeated rows take a slot each, in one shard; null
and repeated ids are told apart by their texts; ties in the seeded order go by id, size and text hash; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.staging import staged
from ruleloom.llm.text import WORD

EXACT, STEPS = 2048, 1024
BUCKETS, BUDGET, SHARD, SEED = 16, 32768, 4096, 23


def binned(length: Column) -> Column:
    """The upper end of a length's histogram bin: itself up to EXACT, above that rounded up by under 0.1 percent."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - 10), F.lit(1.0))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_bounds(ends: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over ascending bin ends that make the least padding.

    best[k][j]: least padded total of the first j bins in k buckets. The cost of a bucket, its last end times
    its count, fulfils the quadrangle inequality, so the best split moves one way and each layer is solved by
    halving.
    """
    n = len(ends)
    if not n:
        return []
    through = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = ends * through[1:]
    splits = []
    for _ in range(1, min(buckets, n)):
        new, split = best.copy(), np.zeros(n, int)
        split[:] = -1
        todo = [(0, n - 1, -1, n - 2)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            # the bucket before ends with bin i; -1: none before
            i = np.arange(max(first, -1), min(last, j - 1) + 1)
            cost = np.where(i < 0, 0, best[i]) + ends[j] * (through[j + 1] - through[i + 1]) if len(i) else np.array([ends[j] * through[j + 1]])
            k = int(np.argmin(cost))
            new[j], split[j] = cost[k], int(i[k]) if len(i) else -1
            todo += [(low, j - 1, first, split[j]), (j + 1, high, split[j], last)]
        splits.append(split)
        best = new
    bounds, j = [], n - 1
    for split in reversed(splits):
        bounds.append(int(ends[j]))
        j = split[j]
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(ends[j]))
    return sorted(set(bounds))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, bucket (from 0), padded (the bucket's bound), batch_id, slot (from 0 in its batch), batch_docs capacity."""
    sizes = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staged(sizes.withColumn("end", binned(F.col("size"))), "packing")
    histogram = sizes.groupBy("end").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("end")
    ends, counts = histogram["end"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    bounds = optimal_bounds(ends, counts, buckets) or [0]
    held = np.bincount(np.searchsorted(bounds, ends), weights=counts, minlength=len(bounds))
    bound, shards = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(max(1, -(-int(n) // shard))) for n in held])
    df = sizes.withColumn("bucket", F.size(F.filter(bound, lambda b: b < F.col("end"))))
    df = df.withColumns({"padded": F.get(bound, F.col("bucket")), "order": F.xxhash64("doc_id", "hash", F.lit(seed)), "shard": F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed + 1)), F.get(shards, F.col("bucket")))})
    df = df.withColumn("capacity", F.greatest(F.floor(F.lit(budget) / F.greatest("padded", F.lit(1))), F.lit(1)).cast("long"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order", "doc_id", "size", "hash")) - 1
    df = df.withColumn("at", at.cast("long"))
    return df.select(
        "doc_id",
        "size",
        "bucket",
        "padded",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("at") / F.col("capacity")).cast("string")).alias("batch_id"),
        (F.col("at") % F.col("capacity")).cast("int").alias("slot"),
        F.col("capacity").alias("batch_docs"),
    )
