"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from ruleloom.llm import components, jaccard, text

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_hand(rows):
    """doc_id -> (set size, least reachable doc_id) by comparing all pairs."""
    sets = {i: grams(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def family(rng, n, length, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def corpus(seed=0):
    rng = random.Random(seed)
    out = [t for n, length, edits in ((30, 120, 4), (60, 40, 2), (12, 300, 9), (25, 9, 1), (40, 200, 6)) for t in family(rng, n, length, edits)]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} {t}" for t in family(rng, 8, 20, 20)] + ["Exact  COPY of it\ttoo"] * 3 + ["exact copy of it too"]
    out += ["a", "A", "b a", "", None, " \n ", "x y z", "x y z ", "ÄÖ x y z w", "äö x y z w"] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(10 * i + 3, out[k]) for i, k in enumerate(order)]


@pytest.fixture(params=["plain", "tight"])
def limits(request, monkeypatch):
    """With small limits large groups take the ways of many blocks and of passed-on counts."""
    if request.param == "tight":
        monkeypatch.setattr(jaccard, "HOT", 3)
        monkeypatch.setattr(jaccard, "BLOCK", 900)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    return request.param


def test_components_equal_all_pairs(spark, limits):
    rows = corpus()
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == by_hand(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "q"), (1, "a b c", "q"), (None, "a b c", "q"), (4, "A B C", "q"), (None, None, None), (9, None, None)], "doc_id long, text string, n_shingles string").selectExpr("doc_id", "text", "n_shingles", "1 AS cls")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert found == sorted([(1, 1, 1), (1, 1, 1), (4, 1, 1), (9, 0, 9), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0
    kept = jaccard.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 9, None, None]


def test_ids_with_several_texts(spark):
    """In the join they are one node; each text counts when one document of each group is kept."""
    x, y, z = ("one two three four five six", "alpha beta gamma delta epsilon zeta", "nur ein anderer Text mit sieben Worten")
    rows = [(5, x, "p"), (5, y, "q"), (1, x, "r"), (2, y, "s"), (5, y, "t"), (7, z, "u"), (7, z, "v"), (8, " ", "w"), (8, "", "x"), (None, x, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").selectExpr("doc_id", "text", "hash", "1 AS label", "2 AS row")
    assert sorted({(r.doc_id, r.component_id) for r in jaccard.join(df).where("doc_id IS NOT NULL").collect()}) == [(1, 1), (2, 1), (5, 1), (7, 7), (8, 8)]
    kept = [tuple(r)[:3] for n in (1, 3) for r in jaccard.without_near_duplicates(df.repartition(n)).collect()]
    assert len(kept) == 12 and len(set(kept)) == 6
    assert {r for r in kept if r[0] != 7} == {(1, x, "r"), (2, y, "s"), (8, " ", "w"), (8, "", "x"), (None, x, "y")}
    # another text of an id stays where it has no earlier copy
    alone = spark.createDataFrame([(1, x), (1, z), (3, x)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.without_near_duplicates(alone).collect())) == [(1, z), (1, x)]


def test_tokens_of_many_classes(monkeypatch):
    """Counts are exact up to the limit and equal above it, wherever batches are cut."""
    monkeypatch.setattr(jaccard, "MOST_COUNTED", 5)
    rows = sorted({(t, c) for t, n in ((1, 1), (2, 3), (3, 40), (4, 2), (5, 1), (6, 6), (7, 1)) for c in range(n)})
    frame = pd.DataFrame([r for r in rows for _ in range(2)], columns=["token", "cls"])
    for size in (1, 3, 7, 1000):
        parts = [p for at in range(0, len(frame), size) for p in jaccard._shared(iter([frame[at : at + size].reset_index(drop=True)]))] if size == 1000 else list(jaccard._shared(frame[at : at + size].reset_index(drop=True) for at in range(0, len(frame), size)))
        got = pd.concat(parts)
        want = [(t, c, min(n, 5)) for t, n in ((2, 3), (3, 40), (4, 2), (6, 6)) for c in range(n)]
        assert sorted(set(map(tuple, got.astype(int).to_numpy().tolist()))) == want


def test_tree_finds_what_links():
    rng = random.Random(3)
    sets = [text.shingle_set(t) for t in [*family(rng, 150, 80, 3), *family(rng, 90, 81, 3), *family(rng, 200, 60, 60)]]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    links = jaccard.Tree(sets).links(np.arange(len(sets)))
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for p, q in links:
        assert root(p) != root(q)
        label[root(p)] = root(q)
    for p in range(len(sets)):
        for q in range(p):
            common = len(np.intersect1d(sets[p], sets[q]))
            if 100 * common >= 80 * (sizes[p] + sizes[q] - common):
                assert root(p) == root(q)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (1, 2), (2, 1)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {k: 7 for k in (7, *range(200, 260))} | {1: 1, 2: 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_shingles_of_very_long_texts():
    unit = "Wort wörter " * 30_000 + "z" * 3_000_000 + " end " + "q" * 5
    assert len(text.word_hashes(unit)) == len(WORD.findall(unit))
    whole, head = text.word_hashes(unit), text.word_hashes("wort WÖrter " + "z" * 3_000_000)
    assert whole[0] == head[0] and whole[1] != head[1] and whole[60_000] == head[2]
    assert text.word_hashes("x " + "z" * 3_000_000)[1] != text.word_hashes("x " + "z" * 2_999_999 + "y")[1]
    assert len(text.shingle_set("a b")) == 1 and len(text.shingle_set("a b c d e f")) == 2 and len(text.shingle_set(None)) == 0


def test_blocks_run_on_in_order(spark, monkeypatch):
    """Blocks are cut where the running sum of a whole neighbourhood says, however its rows are spread."""
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rng = random.Random(4)
    rows = [(hood, rng.randrange(10**9), rng.randrange(1, 20)) for hood, k in ((1, 200), (2, 2), (3, 60)) for _ in range(k)]
    found = jaccard._blocks(spark.createDataFrame(rows, "hood long, cls long, n long"), "n", "cls")
    want = set()
    for hood in (1, 2, 3):
        total = 0
        for n, c in sorted((n, c) for h, c, n in rows if h == hood):
            total += n
            want.add((hood, c, n, (total - 1) // 50))
    assert {(r.hood, r.cls, r.n, r.block) for r in found.collect()} == want


def test_hot_shingles_are_found(spark):
    rows = [(1, c) for c in range(5000)] + [(2, c) for c in range(63)] + [(3, c) for c in range(64)] + [(9 + k, k) for k in range(500)]
    frame = spark.createDataFrame(rows, "token long, cls long")
    assert {(r.token, r["df"]) for r in jaccard._hot(frame).collect()} == {(1, 5000), (3, 64)}
    assert jaccard._hot(frame.limit(0)).count() == 0


def test_only_blocks_that_can_meet_are_paired(spark):
    rare = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 4), (8, 5)], "token long, cls long")
    members = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 2), (4, 0, 0), (5, 1, 1)], "cls long, hood long, block int")
    pairs = spark.createDataFrame([(0, a, b) for a in range(3) for b in range(a, 3)] + [(1, 1, 1)], "hood long, one int, other int")
    assert sorted(map(tuple, jaccard._meeting(pairs, rare, members).collect())) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 1, 1)]


def test_large_sets_do_not_widen_the_bitmaps_of_small_ones():
    rng = np.random.default_rng(3)
    draw = lambda n: np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    sets = [draw(int(n)) for n in np.sort(rng.integers(20, 90, 400))] + [draw(20_000)]
    near = np.sort(np.concatenate([sets[200][2:], draw(2)]))
    sets = sorted([*sets, near], key=len)
    tree = jaccard.Tree(sets)
    assert sum(w.nbytes for w in tree.words) < 2_000_000
    at = next(i for i, s in enumerate(sets) if s is near)
    links = tree.links(np.arange(len(sets)))
    assert len(links) == 1 and at in links[0]


def test_neighbourhoods_step_from_size_to_size_over_batches():
    rows = pd.DataFrame({"token": [1, 1, 1, 1, 1, 2, 2], "n": [10, 12, 15, 40, 50, 50, 60], "cls": [5, 6, 7, 8, 9, 9, 3]})
    want = [(6, 5), (7, 6), (9, 8), (3, 9)]
    for size in (1, 2, 3, 7):
        parts = jaccard._steps(80)(rows[i : i + size] for i in range(0, 7, size))
        assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == want
