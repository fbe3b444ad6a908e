"""Toxicity, quality, neighbours: accuracy on held-out rows, exact sums, odd tables."""

import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ruleloom.llm import neighbours, quality, registry, toxicity
from ruleloom.llm.sampling import labelled_sample

FOLDER = "/root/testdata/sf0.01"
held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int").withColumn("text", F.lit("clash"))


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = docs_of(spark, [(i, f"t{i}") for i in range(200)])
    labels = labels_of(spark, [(i, i % 2) for i in range(200)] + [(3, 1), (4, None), (None, 1)], "toxic")
    some = labelled_sample(docs, labels, "toxic", 50).collect()
    assert len({r.doc_id for r in some}) == 50 and not any(held(r.doc_id) for r in some)
    assert {(r.doc_id, r.y) for r in some} == {(r.doc_id, r.y) for r in labelled_sample(docs.repartition(5), labels, "toxic", 50).collect()}
    assert {r.doc_id for r in labelled_sample(docs, labels, "toxic", 500).collect()} == {i for i in range(200) if not held(i)}


def insulting(rng, n=800):
    """Toxic: an insult beside a group's name, each harmless alone."""
    rows, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))] + [rng.choice(["zog", "brak"])] * insult + [rng.choice(["elves", "gnomes"])] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_of_terms_are_learned(spark):
    rows, labels = insulting(random.Random(1))
    out = toxicity.predictions(docs_of(spark, [*rows, (9001, None), (9002, ""), (5, rows[5][1])]), labels_of(spark, labels, "toxic")).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == held(r.doc_id) for r in out)
    want = dict(labels)
    tested = [r.predicted == want[r.doc_id] for r in out if r.held_out and r.doc_id in want]
    assert len(tested) > 100 and np.mean(tested) > 0.95
    empty = {r.score for r in out if r.doc_id > 9000}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_pairs_without_marginal_signal_are_learned():
    """Toxic is what has exactly one of two words; each is as usual in both classes."""
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))] + ["zog"] * a + ["elves"] * b
        rng.shuffle(words)
        texts.append(toxicity.terms(" ".join(words)))
        labels.append(float(a != b))
    machine = toxicity.fit(texts[:1100], np.array(labels[:1100]))
    assert np.mean([(machine.score(x) >= 0.5) == y for x, y in zip(texts[1100:], labels[1100:], strict=True)]) > 0.95


def test_scores_do_not_depend_on_held_out_labels(spark):
    rows, labels = insulting(random.Random(2), 300)
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        a, b = ({r.doc_id: r.score for r in module.predictions(docs_of(spark, rows), labels_of(spark, x, name)).collect()} for x in (labels, turned))
        assert a == b


def test_held_out_accuracy_on_the_tables(spark):
    for query, label, least in ((registry.op5_toxicity, "toxic", 0.9), (registry.op6_quality, "quality", 0.95)):
        known = registry.table(spark, FOLDER, "labels").select("doc_id", F.col(label).alias("y"))
        tested = query(spark, FOLDER).where("held_out").join(known, "doc_id").collect()
        assert len(tested) > 50 and np.mean([r.predicted == r.y for r in tested]) >= least
        clean = [r.predicted for r in tested if r.y == (label == "quality")]
        assert np.mean([p == (label == "quality") for p in clean]) > 0.97


def test_odd_labels(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None), (None, "c")])
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        for labels, score in (([], 0.0), ([(i, 1) for i in (1, 2, 3)], 1.0), ([(i, 0) for i in (1, 2, 3)], 0.0)):
            out = module.predictions(docs, labels_of(spark, labels, name)).collect()
            assert len(out) == 3 and all(abs(r.score - score) < 1e-6 for r in out)
        assert module.predictions(docs.limit(0), labels_of(spark, [(1, 1)], name)).count() == 0


def test_toxic_documents_go_and_columns_stay(spark):
    rows, labels = insulting(random.Random(3), 400)
    docs = docs_of(spark, rows)
    kept = toxicity.without_toxic(docs, labels_of(spark, labels, "toxic"))
    assert kept.columns == docs.columns
    wrong = {r.doc_id for r in kept.collect()} ^ {i for i, y in labels if not y}
    assert len(wrong) < 20


def test_machine_score_is_the_formula():
    machine = toxicity.Machine(np.array([0, 1, -1, 2]), 0.5, np.array([1.0, -2.0, 0.25]), np.array([[1.0, 2.0], [0.5, -1.0], [0.0, 3.0]]))
    pairs = machine.factors @ machine.factors.T
    total = 0.5 + 1.0 - 2.0 + 0.25 + pairs[0, 1] + pairs[0, 2] + pairs[1, 2]
    assert abs(machine.score(np.array([0, 1, 2, 3])) - 1 / (1 + np.exp(-total))) < 1e-12


def test_votes_are_those_of_all_labelled_vectors():
    rng = np.random.default_rng(1)
    voters = quality.Voters(rng.normal(size=(quality.BUCKETS, 8)).astype(np.float32), quality.unit(rng.normal(size=(200, 8))), rng.integers(0, 2, 200).astype(float), 0.4)
    texts = ["some words | of a text", "other $$$ words\nand lines", "", None]
    own = voters.project(texts)
    for x, score in zip(own[:2], voters.score(texts)[:2], strict=True):
        cosines = voters.vectors @ x
        best = np.argsort(-cosines)[: quality.NEAR]
        weight = np.maximum(cosines[best].astype(float), 0) ** quality.POWER
        assert abs(score - (weight * voters.votes[best]).sum() / weight.sum()) < 1e-5
    assert list(voters.score(texts)[2:]) == [0.4, 0.4]


def test_document_frequencies_cover_all_documents(spark):
    texts = ["a b c", "a $$$ a", None, "", "zz | yy"] * 7
    found = quality.document_frequency(docs_of(spark, list(enumerate(texts))).repartition(3))
    want = np.zeros(quality.BUCKETS + 1, np.int64)
    for t in texts:
        want[0] += 1
        want[quality.terms(t)[0] + 1] += 1
    assert (found == want).all()


# neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("score", F.lit(1))


def by_hand(rows, k):
    usable = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 6}
    out = {}
    for q in usable:
        if q % 20 == 0:
            best = sorted(((-float(usable[q] @ v), i) for i, v in usable.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def found_in(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def close(a, b):
    return a.keys() == b.keys() and all([x for x, _ in a[q]] == [x for x, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=1e-9) for q in a)


def test_small_tables_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(180)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # more copies than neighbours are asked for
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] + [1.0] * 5), (306, [1.0] * 5), (20, rows[20][1]), (None, [1.0] * 6)]
    assert close(found_in(neighbours.nearest(vectors(spark, rows))), by_hand([r for r in rows if r[0] is not None], 20))


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0] * 6), (1, [0.5] * 6), (20, [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    assert close(found_in(neighbours.nearest(vectors(spark, rows))), by_hand(rows, 20))
    none = neighbours.nearest(vectors(spark, []))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_recall_and_codes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    book = neighbours.fit(x[:1000])
    codes = book.encode(x)
    q = x[::100]
    at, sums = neighbours.scan(book, q, codes, 60, rows=700)
    plain = np.stack([codes & 15, codes >> 4], 2).reshape(len(x), -1)
    coded = np.concatenate([book.centroids[s, plain[:, s]] for s in range(16)], 1)
    assert np.allclose(np.take_along_axis(q @ coded.T, at, 1), sums, atol=1e-3)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(at, exact, strict=True)]) > 0.9


def test_direction_errors_weigh_more():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    aware = neighbours.fit(x, threshold=0.5)
    plain = neighbours.Codebook(aware.centroids, 1.0)

    def along(book):
        codes, u, part = book.assign(book.cut(x))
        return float((part.sum(1) ** 2).mean())

    assert along(aware) < 0.7 * along(plain)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in registry.table(spark, FOLDER, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = found_in(registry.op4_nearest(spark, FOLDER))
    hits = [len({i for i, _ in found} & set(ids[np.lexsort((ids, -(x @ x[np.flatnonzero(ids == q)[0]]) + 1e9 * (ids == q)))[:20]])) / 20 for q, found in got.items()]
    assert len(got) == sum(ids % 20 == 0) and np.mean(hits) >= 0.9


def test_no_neighbour_is_lost_to_a_cap(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(1200)]
    rows += [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(1200, 1500)]  # many equal scores
    df = neighbours.usable(vectors(spark, rows))
    found = found_in(neighbours.search(df.where("vec_id % 20 = 0"), df, rerank=21))
    assert close(found, by_hand(rows, 20))


def test_toxicity_is_fitted_away_from_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"you {'rotten ' if i % 3 == 0 else ''}word{i % 7} and more") for i in range(300)] + [(3, "of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 8192).collect()
    texts = {r.doc_id: r for r in sorted(sample, key=lambda r: (r.doc_id, list(toxicity.terms(r.text))), reverse=True)}
    rows = [texts[i] for i in sorted(texts)]
    wanted = toxicity.fit([toxicity.terms(r.text) for r in rows], np.array([float(r.y) for r in rows]))

    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(samples, labels):
        assert os.getpid() != driver, "the sample came to the driver"
        return fit(samples, labels)

    with monkeypatch.context() as patch:
        patch.setattr(toxicity, "fit", elsewhere)
        found = toxicity.train(docs, labels)
    assert (found.slot == wanted.slot).all() and found.bias == wanted.bias and len(wanted.weights)
    assert (found.weights == wanted.weights).all() and (found.factors == wanted.factors).all()
    nothing = toxicity.train(docs.where("doc_id < 0"), labels)
    assert nothing.bias == -30.0 and not len(nothing.weights)
