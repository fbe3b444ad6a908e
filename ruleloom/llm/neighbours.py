"""Nearest neighbours by inner product with score-aware (anisotropic) quantisation.

Vectors are cut into subspaces of two components, each coded by 4 bits (16 centroids). Codes and centroids minimise

    |r|^2 + (ETA - 1) <r, x / |x|>^2,    r = x - coded x,

which weighs the error along x, the one that changes large inner products, more than the error across it; ETA
follows from the threshold THRESHOLD and the number of components. A query's inner products with the centroids make
tables of 16 numbers; the scan adds them up for all coded vectors of a block (two codes in a byte are looked up at
once). Its RERANK best by the tables are scored with the original vectors in double precision; their (K + 1)-th best
score is the query's floor in that block. Every other vector of the block that reaches the floor is scored too, so the
candidates for reranking have no cap and the result is exact at any size: codes decide only how high the floor is.

The codebook is fitted on at most SAMPLE vectors; every vector is coded and every query meets every code, in
blocks of about QUERY_ROWS queries by about BLOCK_ROWS vectors, whatever the size of the table. A task meets the blocks of
one wave one after the other, holds one of them and the K + 1 best of each of its queries, and starts each block with the
floor that those set; K + 1 candidates of each of at most WAVES waves meet for a query. Equal vectors are coded once, with their K + 1 smallest ids, so that copies neither crowd out
the candidates nor make a hot task.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those
whose number of components isn't the most frequent one (the smallest of equally frequent ones); repeated rows count
once; fewer candidates than K: all; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.staging import batch_rows, staged

K, RERANK, SAMPLE, SEED, THRESHOLD = 20, 240, 8192, 3, 0.2
QUERY_ROWS, BLOCK_ROWS, WIDTH = 4096, 16384, 2
WAVES = 256


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0)).select("vec_id", v.alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def distinct_vectors(rows: DataFrame, k: int = K) -> DataFrame:
    """key (the smallest id), ids (the k + 1 smallest, ascending) and v for every distinct vector."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "v")


@dataclass
class Codebook:
    """centroids: subspaces x 16 x WIDTH."""

    centroids: np.ndarray
    eta: float

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows as n x subspaces x WIDTH, padded with zeros."""
        m = len(self.centroids)
        out = np.zeros((len(x), m * WIDTH), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, WIDTH)

    def assign(self, x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of cut rows by coordinate descent, the rows' directions, and the error along them by subspace."""
        u = x / np.maximum(np.sqrt((x.astype(float) ** 2).sum((1, 2), keepdims=True)), 1e-30).astype(np.float32)
        n, m, _ = x.shape
        codes = np.zeros((n, m), np.uint8)
        along = np.zeros((n, m), np.float32)
        for turn in range(rounds + 1):
            for s in range(m):
                error = x[:, s, None, :] - self.centroids[None, s]
                cost, part = (error**2).sum(2), (error * u[:, s, None, :]).sum(2)
                if turn:
                    cost = cost + (self.eta - 1) * ((along.sum(1) - along[:, s])[:, None] + part) ** 2
                codes[:, s] = cost.argmin(1)
                along[:, s] = np.take_along_axis(part, codes[:, s, None].astype(int), 1)[:, 0]
        return codes, u, along

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte: n x ceil(subspaces / 2)."""
        codes = self.assign(self.cut(x))[0]
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of a code its 256 sums of two products, for every query: bytes x 256 x queries."""
        t = np.einsum("qsw,skw->skq", self.cut(queries), self.centroids).astype(np.float32)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros((1, *t.shape[1:]), np.float32)])
        return (t[1::2, :, None, :] + t[::2, None, :, :]).reshape(len(t) // 2, 256, -1)


def fit(sample: np.ndarray, threshold: float = THRESHOLD, seed: int = SEED) -> Codebook:
    """A codebook by plain k-means in each subspace, then rounds of score-aware assignment and updates."""
    d = sample.shape[1]
    m = -(-d // WIDTH)
    book = Codebook(np.zeros((m, 16, WIDTH), np.float32), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    x = book.cut(sample)
    rng = np.random.default_rng(seed)
    book.centroids = np.stack([x[rng.choice(len(x), 16, replace=len(x) < 16), s] for s in range(m)])
    for turn in range(16):
        codes, u, along = book.assign(x, rounds=0 if turn < 10 else 1)
        weight = 0.0 if turn < 10 else book.eta - 1
        for s in range(m):
            other = along.sum(1) - along[:, s]
            us, xs = u[:, s], x[:, s]
            left = np.eye(WIDTH)[None] + weight * us[:, :, None] * us[:, None, :]
            right = xs + weight * us * (other + (xs * us).sum(1))[:, None]
            a, b = np.zeros((16, WIDTH, WIDTH)), np.zeros((16, WIDTH))
            np.add.at(a, codes[:, s], left)
            np.add.at(b, codes[:, s], right)
            some = np.bincount(codes[:, s], minlength=16) > 0
            book.centroids[s, some] = np.linalg.solve(a[some], b[some][:, :, None])[:, :, 0]
            if not some.all():
                book.centroids[s, ~some] = xs[rng.choice(len(xs), int((~some).sum()))]
    return book


def scan(book: Codebook, queries: np.ndarray, codes: np.ndarray, best: int, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Table sums of the best codes for each query: places and sums, queries x best."""
    tables = book.tables(queries)
    at, sums = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.float32)
    for low in range(0, len(codes), rows):
        part = codes[low : low + rows]
        total = tables[0][part[:, 0]]
        for j in range(1, part.shape[1]):
            total += tables[j][part[:, j]]
        at = np.concatenate([at, np.broadcast_to(np.arange(low, low + len(part)), (len(queries), len(part)))], 1)
        sums = np.concatenate([sums, total.T], 1)
        if sums.shape[1] > best:
            keep = np.argpartition(-sums, best - 1, axis=1)[:, :best]
            at, sums = np.take_along_axis(at, keep, 1), np.take_along_axis(sums, keep, 1)
    return at, sums


def candidates(book: Codebook, queries: np.ndarray, codes: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int, rerank: int, rows: int = 2048, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a query, keys, scores) of each query's k best rows of x, equal scores by the smaller key; none is missed.

    A row is left out only if its product is below the floor by more than double precision can err. floors: scores
    that each query's k-th best has already; rows below them may be left out.
    """
    d, k = x.shape[1], min(k, len(x))
    margin = 4 * d * np.finfo(float).eps * np.sqrt((x.astype(float) ** 2).sum(1).max())
    for first in range(0, len(queries), 256):
        some = queries[first : first + 256]
        q = some.astype(float)
        at = scan(book, some, codes, max(rerank, k), rows)[0]
        floor = np.array([np.partition(x[a].astype(float) @ v, len(a) - k)[len(a) - k] for a, v in zip(at, q, strict=True)])
        if floors is not None:
            floor = np.maximum(floor, floors[first : first + 256])
        floor -= margin * np.sqrt((q**2).sum(1))
        asked, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for low in range(0, len(x), rows):
            i, j = np.nonzero(q @ x[low : low + rows].T.astype(float) >= floor[:, None])
            part, right = np.zeros(len(i)), x[low + j]
            for c in range(d):  # in the order of product(), so that equal scores are equal here too
                part += q[i, c] * right[:, c]
            asked, place, score = np.concatenate([asked, i]), np.concatenate([place, low + j]), np.concatenate([score, part])
            order = np.lexsort((keys[place], -score, asked))
            asked, place, score = asked[order], place[order], score[order]
            best = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
            asked, place, score = asked[best], place[best], score[best]
        ends = np.searchsorted(asked, np.arange(len(some) + 1))
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            yield first + n, keys[place[a:b]], score[a:b]


class Best:
    """The k best (key, score) of each query of one asker so far."""

    def __init__(self, asker: int, ids: np.ndarray, k: int) -> None:
        self.asker, self.ids, self.k = asker, ids, k
        self.keys, self.scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)

    def floors(self) -> np.ndarray:
        return np.array([s[-1] if len(s) == self.k else -np.inf for s in self.scores])

    def add(self, n: int, keys: np.ndarray, scores: np.ndarray) -> None:
        if len(keys):
            keys, scores = np.concatenate([self.keys[n], keys]), np.concatenate([self.scores[n], scores])
            order = np.lexsort((keys, -scores))[: self.k]
            self.keys[n], self.scores[n] = keys[order], scores[order]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids, "keys": self.keys, "below": [0.0 - s for s in self.scores]})


def matrix(vectors: pd.Series, dtype: type = np.float32) -> np.ndarray:
    return np.array([np.asarray(x, dtype) for x in vectors], dtype)


def product(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, rows: DataFrame, k: int = K, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows but itself; queries and rows as from usable()."""
    spark = rows.sparkSession
    kept = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    vectors = staged(distinct_vectors(rows, k), "vectors")
    asked = queries.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    fitted = vectors.orderBy(F.xxhash64("key", F.lit(SEED)), "key").limit(sample).select("v").toPandas()
    if fitted.empty:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    book = spark.sparkContext.broadcast(fit(matrix(fitted["v"])))  # 16 centroids for each subspace
    n = vectors.count()
    blocks, askers = -(-n // BLOCK_ROWS), max(1, -(-asked.count() // QUERY_ROWS))

    def coded(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "codes": [book.value.encode(matrix(pdf["v"])).tobytes()], "x": [matrix(pdf["v"], kept).tobytes()], "keys": [pdf["key"].to_numpy(np.int64).tobytes()]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asker": [pdf["asker"].iloc[0]], "queries": [matrix(pdf["q"], kept).tobytes()], "ids": [pdf["query_id"].to_numpy(np.int64).tobytes()]})

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            for asker, codes, x, keys, asking, ids in zip(batch["asker"], batch["codes"], batch["x"], batch["keys"], batch["queries"], batch["ids"], strict=True):
                keys, ids = np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64)
                x, asking = np.frombuffer(x, kept).reshape(len(keys), -1), np.frombuffer(asking, kept).reshape(len(ids), -1)
                if best is None or best.asker != asker:
                    if best is not None:
                        yield best.rows()
                    best = Best(asker, ids, k + 1)  # the query itself may be one of them
                for n, near, scores in candidates(book.value, asking, np.frombuffer(codes, np.uint8).reshape(len(keys), -1), x, keys, k + 1, rerank, floors=best.floors()):
                    best.add(n, near, scores)
        if best is not None:
            yield best.rows()

    data = vectors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(coded, "block int, codes binary, x binary, keys binary")
    asking = asked.withColumn("asker", F.pmod(F.xxhash64("query_id"), F.lit(askers)).cast("int")).groupBy("asker").applyInPandas(gathered, "asker int, queries binary, ids binary")
    # every block of queries meets every block of codes; a merge join leaves the rows of one asker and wave side by side
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("wave", F.col("block") % WAVES).withColumn("asker", places(askers))
    pairs = data.join(asking.withColumn("wave", places(min(blocks, WAVES))), ["asker", "wave"])
    with batch_rows(spark, 2):  # a row is a block of vectors
        near = staged(pairs.select("asker", "codes", "x", "keys", "queries", "ids").mapInPandas(scanned, "query_id long, keys array<long>, below array<double>"), "near")
    lists = near.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("below", "keys"))).alias("near"))
    near = lists.select("query_id", F.explode(F.slice(F.sort_array("near"), 1, k + 1)).alias("near")).select("query_id", F.col("near.keys").alias("key"))
    exact = near.join(vectors, "key").join(asked, "query_id").select("query_id", F.explode("ids").alias("vec_id"), product(F.col("q"), F.col("v")).alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = exact.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """What op4_nearest returns: the queries are the rows whose vec_id is divisible by `every`."""
    rows = usable(embeddings)
    return search(rows.where(F.col("vec_id") % every == 0), rows)
