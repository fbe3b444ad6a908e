"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text, hashed to BUCKETS: its words, the shapes of its words' ends (which letters, digits and marks
close a word), the length of its words and how much it repeats itself (words, lines). Counts are damped by a square
root and weighted by inverse document frequency over all documents (one count for each bucket). Latent axes come from a
randomised singular value decomposition of the labelled sample. Each document's vector is compared with every
labelled vector by exact cosines, in blocks (a matrix product for a batch of documents), and its NEAR nearest
neighbours vote with their labels, weighted by similarity.

The labelled vectors are bounded by SAMPLE rows of AXES numbers; so is what is broadcast.

Edge cases: null and empty texts have no terms and get the sample's share of label 1, as has any text whose vector is
zero; with no labelled rows every score is 0; repeated rows are scored each, and of repeated labels the largest
counts; of labelled vectors that are equally near at the edge those of smaller doc_id vote; texts of any length are read
whole, in pieces; an empty table gives no rows; score() replaces a column of that name, and other columns pass through.
Products are single precision, so a score may differ in its last digits with the batch that a row is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.sampling import held_out, labelled_sample
from ruleloom.llm.staging import small_batches
from ruleloom.llm.text import ALNUM, SPACES, mix, word_hashes

BITS = 13
BUCKETS = 1 << BITS
SAMPLE, AXES, NEAR, POWER, SEED = 4096, 48, 25, 4, 5
_CLASS = np.full(256, 1, np.uint64)  # letters 1, digits 2, any other byte its own
_CLASS[~ALNUM] = np.arange(256, dtype=np.uint64)[~ALNUM] + 8
_CLASS[48:58] = 2
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES)] = True


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + np.uint64(kind * 0x51ED270B)) >> np.uint64(64 - BITS)).astype(np.int32)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, ascending, and damped counts of a text's terms."""
    if not text or not len(words := word_hashes(text)):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] & ~blank[:-1])  # last bytes of words but for the text's last word
    last = _CLASS[data[edge]]
    before = _CLASS[data[np.maximum(edge - 1, 0)]]
    n, (_, counts) = len(words), np.unique(words, return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = np.array([10 * (n - len(counts)) // n, 100 + 20 * int(counts.max()) // n, 200 + (10 * (len(lines) - len(set(lines))) // len(lines) if lines else 0)], np.uint64)
    weight = max(1, n // 4)
    parts = [_bucket(words, 1), _bucket(before * np.uint64(300) + last, 2), _bucket(np.minimum(np.diff(edge), 24).astype(np.uint64), 3)]
    total = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    total += np.bincount(_bucket(repeats, 4), minlength=BUCKETS) * weight
    at = np.flatnonzero(total).astype(np.int32)
    return at, np.sqrt(total[at], dtype=np.float32)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """In how many documents each bucket occurs, over all documents; the first number is that of the documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for x in batch["text"]:
                total[terms(x)[0] + 1] += 1
                total[0] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"]
    return out


@dataclass
class Voters:
    """idf and axes: weights of the buckets; vectors: labelled, of unit length; votes: their labels; share: of label 1."""

    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    share: float

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for i, x in enumerate(texts):
            at, count = terms(x)
            if len(at):
                out[i] = count @ self.axes[at]
        return unit(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        own = self.project(texts)
        if not len(self.votes):
            return np.zeros(len(texts))
        near = min(NEAR, len(self.votes))
        cosines = own @ self.vectors.T
        at = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        edge = np.take_along_axis(cosines, at, axis=1).min(1, keepdims=True)
        for i in np.flatnonzero((cosines >= edge).sum(1) > near):
            at[i] = np.argsort(-cosines[i], kind="stable")[:near]
        weight = np.maximum(np.take_along_axis(cosines, at, axis=1), 0).astype(float) ** POWER
        total = weight.sum(1)
        voted = (weight * self.votes[at]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where((total > 0) & (own != 0).any(1), voted, self.share), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, frequency: np.ndarray, axes: int = AXES, seed: int = SEED) -> Voters:
    """Latent axes of the bounded sample, and its vectors on them."""
    idf = np.log((1 + frequency[0]) / (1 + frequency[1:])).astype(np.float32) + 1
    if not len(labels):
        return Voters(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.0)
    rows = []
    for at, count in samples:
        x = count * idf[at]
        rows.append((at, x / max(1e-12, float(np.sqrt((x.astype(float) ** 2).sum())))))
    wide = min(axes + 8, len(rows))
    basis = np.random.default_rng(seed).normal(size=(BUCKETS, wide)).astype(np.float32)
    for _ in range(4):
        left, _ = np.linalg.qr(np.array([x @ basis[at] for at, x in rows], np.float32).reshape(len(rows), wide))
        basis = np.zeros((BUCKETS, wide), np.float32)
        for (at, x), y in zip(rows, left, strict=True):
            basis[at] += np.outer(x, y)
    # basis = rows^T left: its right singular vectors are the latent axes
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    weights = (u[:, :axes] * idf[:, None]).astype(np.float32)
    vectors = np.array([c @ weights[at] if len(at) else np.zeros(weights.shape[1]) for at, c in samples], np.float32)
    return Voters(weights, unit(vectors), labels.astype(float), float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Voters:
    """Voters from at most `bound` labelled rows; terms are counted in Spark tasks, over all documents for the weights."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<at:array<int>,count:array<float>>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [terms(x) for x in batch]
            yield pd.DataFrame({"at": [a for a, _ in found], "count": [c for _, c in found]}, index=batch.index)

    frequency = document_frequency(docs)
    rows = labelled_sample(docs, labels, label, bound).select("doc_id", "y", counted("text").alias("t")).select("doc_id", "y", "t.at", "t.count").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").head(bound)
    samples = [(np.asarray(a, np.int32), np.asarray(c, np.float32)) for a, c in zip(rows["at"], rows["count"], strict=True)]
    return fit(samples, rows["y"].to_numpy(float), frequency)


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """docs with score, 0 to 1, of the whole text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(voters)  # at most SAMPLE + BUCKETS rows of AXES numbers

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.value.score(list(batch)), index=batch.index, dtype=float)

    return docs.withColumn("score", scored("text"))


def predictions(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """What op6_quality returns."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
