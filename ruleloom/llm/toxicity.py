"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (letters and digits, A-Z lower-cased) and their first 4 and 6 bytes, hashed to
BUCKETS; a text is the set of its terms. The machine scores

    w0 + sum w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

so a pair of terms (an insult and the mention of a group) can weigh more than its parts. It is fitted on a
bounded sample of labelled rows (SAMPLE). Terms that tell nothing in the sample have no weight, so long texts do not
gather noise: kept are the KEEP strongest by z-score of their document counts in both classes, and both terms of each of
the PAIRS pairs whose joint occurrence tells most beyond what the two tell by themselves, so a pair is learned
also if each of its terms is as usual in both classes. Pairs are counted, in the sample, among the COMMON most
frequent terms but for those that nearly every text has.

Edge cases: null and empty texts have no terms and the score of the bias; repeated rows are scored each, and of
repeated labels the largest counts; with no labelled rows, or one class only, every score is that class's share (0
without rows); an empty table gives no rows; very long texts are hashed in pieces, whole; equally strong terms are
kept by bucket; score() replaces a column of that name, and other columns pass through, whatever their names.
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
from ruleloom.llm.text import ALNUM, word_hashes

BUCKETS = 1 << 18
PREFIXES = (4, 6)
SAMPLE, KEEP, FACTORS, EPOCHS, SEED = 8192, 4096, 4, 12, 11
PAIRS, COMMON = 512, 2048
#: Least z-scores of a term, and of a pair (of which there are millions).
TERM_Z, PAIR_Z = 2.5, 6.5


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    return np.unique((word_hashes(text, prefixes=PREFIXES, is_word=ALNUM) >> np.uint64(64 - 18)).astype(np.int32))


@dataclass
class Machine:
    """slot: for each bucket the row of its weights, or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        at = self.slot[buckets]
        at = at[at >= 0]
        v = self.factors[at]
        total = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def telling_terms(samples: list[np.ndarray], labels: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The buckets that get weights: those that tell by themselves, and those of telling pairs; ascending."""
    n, positive = len(labels), float(labels.sum())
    inside, outside = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(samples, labels, strict=True):
        (inside if y else outside)[x] += 1
    both = inside + outside
    p = both / n
    z = (inside / positive - outside / (n - positive)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / positive + 1 / (n - positive)))
    z[both < 2] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:keep]
    best = best[np.abs(z[best]) >= TERM_Z]
    common = np.argsort(-np.where(p <= 0.95, both, 0), kind="stable")[:COMMON]
    common = np.sort(common[(both[common] >= 10) & (p[common] <= 0.95)])
    place = np.full(BUCKETS, -1)
    place[common] = np.arange(len(common))
    # counted in blocks of rows, and scored in blocks of terms, so that only the two tables of counts are held
    together, positives = np.zeros((len(common), len(common)), np.float32), np.zeros((len(common), len(common)), np.float32)
    for first in range(0, n, 512):
        has = np.zeros((min(512, n - first), len(common)), np.float32)
        for row, x in zip(has, samples[first : first + 512], strict=True):
            at = place[x]
            row[at[at >= 0]] = 1
        together += has.T @ has
        has = has[labels[first : first + 512] == 1]
        positives += has.T @ has
    alone = np.diag(positives) / np.maximum(np.diag(together), 1)
    share = positive / n
    score, left, right = np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    for first in range(0, len(common), 256):
        count = together[first : first + 256]
        expected = count * np.clip(alone[first : first + 256, None] + alone[None] - share, 0, 1)
        spread = count * share * (1 - share)
        beyond = np.triu(np.abs(np.where(spread >= 3, (positives[first : first + 256] - expected) / np.sqrt(np.maximum(spread, 1e-9)), 0)), first + 1)
        i, j = np.nonzero(beyond >= PAIR_Z)
        score, left, right = np.concatenate([score, beyond[i, j]]), np.concatenate([left, first + i]), np.concatenate([right, j])
        order = np.lexsort((right, left, -score))[:PAIRS]
        score, left, right = score[order], left[order], right[order]
    return np.unique(np.concatenate([best, common[left], common[right]]))


def fit(samples: list[np.ndarray], labels: np.ndarray, keep: int = KEEP, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """A machine by adaptive gradient steps on the logistic loss, rows in seeded order; on the bounded sample only."""
    slot = np.full(BUCKETS, -1, np.int32)
    n, positive = len(labels), float(labels.sum())
    share = positive / n if n else 0.0
    if not 0 < share < 1:
        return Machine(slot, 30.0 if share == 1 else -30.0, np.zeros(0), np.zeros((0, factors)))
    best = telling_terms(samples, labels, keep)
    slot[best] = np.arange(len(best), dtype=np.int32)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(best)), rng.normal(0, 0.01, (len(best), factors)), float(np.log(share / (1 - share)))
    gw, gv = np.full(len(best), 1e-2), np.full((len(best), factors), 1e-2)
    rows = [s[s >= 0] for s in (slot[x] for x in samples)]
    rate, decay = 0.2, 1e-4
    for _ in range(epochs):
        for i in rng.permutation(n):
            at = rows[i]
            vi = v[at]
            s = vi.sum(0)
            total = bias + w[at].sum() + 0.5 * ((s**2).sum() - (vi**2).sum())
            g = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[i]
            bias -= 0.002 * g
            if not len(at) or abs(g) < 1e-4:
                continue
            dw, dv = g + decay * w[at], g * (s - vi) + decay * vi
            gw[at] += dw**2
            gv[at] += dv**2
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= 0.3 * rate * dv / np.sqrt(gv[at])
    return Machine(slot, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Machine:
    """Fit on at most `bound` labelled rows, in one task; the terms are made in many. Only the machine comes to the driver.

    Of several texts of one doc_id that with the least terms counts.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def buckets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([terms(x) for x in batch], index=batch.index, dtype=object)

    def machine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (parts := list(batches)):
            return
        rows = pd.concat(parts).drop_duplicates("doc_id").head(bound)
        found = fit([np.asarray(x, np.int32) for x in rows["terms"]], rows["y"].to_numpy(float))
        kept = np.flatnonzero(found.slot >= 0)
        yield pd.DataFrame({"kept": [kept[np.argsort(found.slot[kept])]], "bias": [found.bias], "weights": [found.weights], "factors": [found.factors.ravel()]})

    rows = labelled_sample(docs, labels, label, bound).select("doc_id", "y", buckets("text").alias("terms"))
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "terms")
    found = rows.mapInPandas(machine, "kept array<long>, bias double, weights array<double>, factors array<double>").first()
    if found is None:
        return fit([], np.zeros(0))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[found["kept"]] = np.arange(len(found["kept"]), dtype=np.int32)
    return Machine(slot, found["bias"], np.array(found["weights"]), np.array(found["factors"]).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score, 0 to 1, of the whole text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS numbers and KEEP rows of weights

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.value.score(terms(x)) for x in batch], index=batch.index)

    return docs.withColumn("score", scored("text"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op5_toxicity returns."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents whose score is under limit, columns unchanged."""
    kept = score(docs.select(F.struct("*").alias("row"), "text"), train(docs, labels)).where(F.col("score") < limit)
    return kept.select("row.*")
