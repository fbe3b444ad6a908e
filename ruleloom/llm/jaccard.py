"""N-gram Jaccard join by signature trees: all links at similarity 0.8 or more, as components.

1. Each text becomes its set of five-word shingles (64-bit hashes); equal sets are one class.
2. Each class shows its shingles with hashes in the lowest SHOWN of all, or, if these are fewer than n - ceil(0.8 n)
   + 1, so many of its lowest. A set that links misses at most d = n - ceil(0.8 n) of them. So a class that shows e
   shingles, fewer than e - d of which others show as well, links with nothing; of each other class the d + 1
   rarest shown ones (by the exact number of classes that show them) include one that every linked class has
   among its own. Classes with such a shingle in common are joined to a neighbourhood if their sizes allow for a link: a
   component of steps from size to size, for each shingle.
3. A neighbourhood is one signature tree, cut into blocks of BLOCK shingles if it is large. Leaves hold bitmaps of
   their classes' shingles; nodes above hold the OR of their children's bitmaps and the range of their sizes. The
   traversal starts from the pair (root, root) and drops a pair of nodes if the sizes rule a link out, if the most
   that two members can have in common - bits in common plus the largest number of shingles that share bits - is
   too little, or if all their members are connected already.
4. Pairs of classes that are left are compared exactly; what links is emitted until all is connected, so a dense
   group of n near copies gives n - 1 links, not n * n / 2.
5. Blocks of one neighbourhood meet in a second round, dealt anew by the components found so far: pairs of blocks
   within one component are dropped, so a group that holds a large part of the corpus is compared along its edge, and
   so are pairs of blocks without a rare shingle in common, so neighbourhoods that boilerplate has chained up are compared
   where texts can link. Only then are the sets of the remaining blocks made again and sent.

No document, candidate or partner is dropped for being frequent. Shingles that hold a large part of the shown ones
(found on a bounded sample, which decides about their way only) are spread by class instead of meeting in a task,
and a large neighbourhood is cut to blocks by ranges. The set hashes have 64 bits: two different sets
are taken for equal, or two shingles for one, with a chance of 2**-64 for each pair.

Edge cases: texts that are null or without words have an empty set and link with nothing; with fewer than five
words the whole sequence is the one shingle; texts of any length are read whole; equal texts and repeated rows are one
class, whatever their number; rows of one doc_id with different texts are one node, which links whatever
one of them links; a null doc_id has a null component and links nothing; an empty table gives no rows; sets of just
80 percent link; other columns are ignored by join(), and passed through by without_near_duplicates(), whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.components import components
from ruleloom.llm.staging import batch_rows, drop, small_batches, staged
from ruleloom.llm.text import WORD, mix, shingle_set

WIDTH, PERCENT = 5, 80
#: The share of all hashes whose shingles are shown. More than 1 - PERCENT / 100, or nothing would be told apart.
SHOWN = 0.3
#: Counts above this are equal in the order of rarity, so that a shingle of very many classes is passed on unheld.
MOST_COUNTED = 1 << 16
BLOCK, LEAF, FAN = 1 << 21, 32, 8
#: A shingle with HOT rows or more among about HOT_SAMPLE sampled ones is hot, so at most HOT_SAMPLE / HOT of them are.
HOT_SAMPLE, HOT = 1 << 22, 64
#: Ids are broadcast to the scan of the texts up to so many; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1 << 19


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    if not len(tokens):
        return 0
    places = mix(np.arange(1, len(tokens) + 1, dtype=np.uint64))
    total = mix(tokens ^ places).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def least_overlap(a, b, percent: int = PERCENT):
    """The least size of the intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def shown(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The lowest hashes of a sorted set: all below SHOWN, and n - ceil(percent n / 100) + 1 at least."""
    n = len(tokens)
    below = int(np.searchsorted(tokens, np.uint64(int(SHOWN * 2**64))))
    return tokens[: max(below, n - (-(-percent * n // 100)) + 1) if n else 0]


def _profiles(width: int, percent: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc, x in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(x, width)
                c, tokens = class_of(s), shown(s, percent)
                # a task shows a class once, however many copies it meets; a row without id shows nothing
                first = c not in seen and not pd.isna(doc)
                if first:
                    seen.add(c)
                rows.append((len(s), c, len(tokens), tokens.view(np.int64) if first and len(s) else None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "hash": batch["hash"], "n": [r[0] for r in rows], "cls": [r[1] for r in rows], "e": [r[2] for r in rows], "tokens": [r[3] for r in rows]})

    return run


def _hot(rows: DataFrame) -> DataFrame:
    """token, df of the hot shingles of rows (token, cls), df scaled up from the classes of the sample."""
    n = rows.count()
    share = min(1.0, HOT_SAMPLE / max(1, n))
    sampled = rows.where(F.xxhash64("cls") <= min(2**63 - 1, int((2 * share - 1) * 2**63)))
    counts = sampled.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= HOT)
    return counts.select("token", F.least(F.col("k") / share, F.lit(2**31 - 1)).cast("int").alias("df"))


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows in order of (token, cls): the distinct rows of tokens of several classes, with their number."""
    token, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = None  # a token of over MOST_COUNTED classes, whose rows are passed on at once
    for batch in batches:
        token, cls = np.concatenate([token, batch["token"].to_numpy()]), np.concatenate([cls, batch["cls"].to_numpy()])
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = int(starts[-1])  # the last token may go on in the next batch
        if len(token) - held >= MOST_COUNTED or token[held] == open_:
            open_ = int(token[held])
            held = len(token)
        sizes = np.diff(np.append(starts[starts < held], held))
        counts = np.minimum(sizes, MOST_COUNTED)
        if len(counts):
            counts[token[starts[: len(counts)]] == open_] = MOST_COUNTED
        counts = np.repeat(counts, sizes)
        several = counts > 1
        yield pd.DataFrame({"token": token[:held][several], "cls": cls[:held][several], "df": counts[several]})
        token, cls = token[held:], cls[held:]
    if len(token) > 1:
        yield pd.DataFrame({"token": token, "cls": cls, "df": np.full(len(token), len(token))})


def _steps(percent: int) -> Callable:
    """From rows in order of (token, n, cls): an edge from each class to the one before it, if a link allows for such sizes.

    Sizes between two that may link may link with both, so all classes of a token that may link are connected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = {"token": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64)}
        for batch in batches:
            token, n, cls = (np.concatenate([last[c], batch[c].to_numpy()]) for c in ("token", "n", "cls"))
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (cls[1:] != cls[:-1])
            yield pd.DataFrame({"a": cls[1:][near], "b": cls[:-1][near]}).drop_duplicates()
            last = {"token": token[-1:], "n": n[-1:], "cls": cls[-1:]}

    return run


def _bits(largest: int) -> int:
    return 1 << int(np.clip(np.ceil(np.log2(4 * largest)), 9, 17))


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps in fewer words, as if they had been made so."""
    return words if words.shape[1] == width else np.bitwise_or.reduce(words.reshape(len(words), -1, width), axis=1)


class Tree:
    """Bitmaps and sizes of sorted sets, best in order of size, and of the nodes above them; level 0 has the leaves.

    The sets of a leaf have bitmaps as wide as its largest set asks for, so a few large sets among many small ones cost
    these nothing; nodes have bitmaps of one width.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        bits = _bits(self.sizes.max())
        cut = np.arange(0, len(sets), LEAF)
        words, excess = np.zeros((len(cut), bits // 64), np.uint64), np.zeros(len(cut), np.int64)
        self.words = []
        for leaf, start in enumerate(cut):
            part = sets[start : start + LEAF]
            own = np.zeros((len(part), _bits(self.sizes[start : start + LEAF].max()) // 64), np.uint64)
            for row, s in zip(own, part, strict=True):
                self._mark(row, s)
                at = self._mark(words[leaf], s)
                excess[leaf] = max(excess[leaf], len(s) - len(np.unique(at)))
            self.words.append(own)
        low, high = np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut)
        step = LEAF
        self.levels = [(step, words, low, high, excess)]
        while len(words) > 1:
            cut, step = np.arange(0, len(words), FAN), step * FAN
            words = np.bitwise_or.reduceat(words, cut, axis=0)
            low, high, excess = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)
            self.levels.append((step, words, low, high, excess))

    @staticmethod
    def _mark(row: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Set the tokens' bits, and return their places."""
        at = tokens & np.uint64(64 * len(row) - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return at

    def links(self, labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
        """Pairs of members that connect all that links connect. labels: members with equal ones are connected already."""
        found: list[tuple[int, int]] = []
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            step, words, low, high, excess = self.levels[level]
            if 100 * min(high[i], high[j]) < percent * max(low[i], low[j]):
                continue
            least = least_overlap(low[i], low[j], percent)
            if i != j and int(np.bitwise_count(words[i] & words[j]).sum()) + min(excess[i], excess[j]) < least:
                continue
            a, b = slice(i * step, (i + 1) * step), slice(j * step, (j + 1) * step)
            if (labels[a] == labels[a.start]).all() and (labels[b] == labels[a.start]).all():
                continue
            if level:
                below = len(self.levels[level - 1][1])
                left, right = range(i * FAN, min((i + 1) * FAN, below)), range(j * FAN, min((j + 1) * FAN, below))
                todo += [(level - 1, x, y) for x in left for y in right if x <= y]
                continue
            width = min(self.words[i].shape[1], self.words[j].shape[1])
            x, y = _folded(self.words[i], width), _folded(self.words[j], width)
            common = np.bitwise_count(x[:, None] & y[None]).sum(2, dtype=np.int64)
            beside = [self.sizes[part] - np.bitwise_count(w).sum(1, dtype=np.int64) for part, w in ((a, x), (b, y))]
            most = common + np.minimum(beside[0][:, None], beside[1][None])
            open_ = (most >= least_overlap(self.sizes[a][:, None], self.sizes[b][None], percent)) & (labels[a][:, None] != labels[b][None])
            for x, y in np.argwhere(open_):
                p, q = a.start + int(x), b.start + int(y)
                if (i != j or p < q) and labels[p] != labels[q] and self.linked(p, q, percent):
                    found.append((p, q))
                    labels[labels == labels[q]] = labels[p]
        return found

    def linked(self, p: int, q: int, percent: int) -> bool:
        s, t = (self.sets[p], self.sets[q]) if len(self.sets[p]) <= len(self.sets[q]) else (self.sets[q], self.sets[p])
        at = np.searchsorted(t, s)
        common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        return 100 * common >= percent * (len(s) + len(t) - common)


def _traversed(percent: int) -> Callable:
    """Rows (task, cls, label, n, tokens), sorted by task, to links (a, b); the rows of a task are one tree."""

    def flush(rows: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        rows = sorted({c: (len(s), c, x, s) for c, x, s in rows}.values(), key=lambda r: (r[0], r[1]))
        if len(rows) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        _, labels = np.unique(np.array([r[2] for r in rows]), return_inverse=True)
        links = Tree([r[3] for r in rows]).links(labels.astype(np.int64), percent)
        return pd.DataFrame({"a": [rows[p][1] for p, _ in links], "b": [rows[q][1] for _, q in links]}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, rows = None, []
        for batch in batches:
            for t, c, x, tokens in zip(batch["task"], batch["cls"], batch["label"], batch["tokens"], strict=True):
                if t != task:
                    if rows:
                        yield flush(rows)
                    task, rows = t, []
                rows.append((c, x, np.frombuffer(tokens, np.uint64)))
        if rows:
            yield flush(rows)

    return run


def _with_sets(docs: DataFrame, wanted: DataFrame, n: int, width: int) -> DataFrame:
    """wanted (doc_id, cls, ...) with tokens; a doc_id with several texts gives the one of cls."""

    names = wanted.columns

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(x, width) for x in batch["text"]]
            right = [class_of(s) == c for s, c in zip(found, batch["cls"], strict=True)]
            yield batch[names].assign(tokens=[s.tobytes() for s in found])[right]

    schema = ", ".join(f"{name} {kind}" for name, kind in [*wanted.dtypes, ("tokens", "binary")])
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "doc_id")
    return rows.select(*names, "text").mapInPandas(sets, schema)


def _blocks(members: DataFrame, *order: str) -> DataFrame:
    """members with block: runs of about BLOCK shingles within each neighbourhood, in the given order.

    Only neighbourhoods of more shingles are put in order, by ranges, of which running sums are made one by one.
    """
    wide = members.groupBy("hood").agg(F.sum("n").alias("of_hood")).where(F.col("of_hood") > BLOCK)
    small = members.join(wide, "hood", "left_anti").withColumn("block", F.lit(0))
    ranges = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.join(wide, "hood", "left_semi").repartitionByRange(ranges, "hood", *order)
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("hood", "part").agg(F.sum("n").alias("of_part"))
    before = F.sum("of_part").over(Window.partitionBy("hood").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("hood", "part", F.coalesce(before, F.lit(0)).alias("before"))
    through = F.sum("n").over(Window.partitionBy("hood", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = ranged.withColumn("through", through).join(sums, ["hood", "part"])
    cut = cut.withColumn("block", F.floor((F.col("before") + F.col("through") - 1) / BLOCK).cast("int"))
    out = staged(small.union(cut.select(small.columns)), "blocks")
    drop(ranged)
    return out


def _meeting(pairs: DataFrame, rare: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of blocks (hood, one, other) that hold a rare shingle in common. Classes that link have one, so no link is lost.

    What a block holds is bounded by BLOCK.
    """
    held = rare.join(members.select("cls", "hood", "block"), "cls").groupBy("hood", "block").agg(F.collect_set("token").alias("held"))
    for side in ("one", "other"):
        pairs = pairs.join(held.select("hood", F.col("block").alias(side), F.col("held").alias(f"held_{side}")), ["hood", side])
    return pairs.where(F.arrays_overlap("held_one", "held_other")).select("hood", "one", "other")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task").select("task", "cls", "label", "tokens").mapInPandas(_traversed(percent), "a long, b long")


def _ids_as_links(profiles: DataFrame) -> DataFrame:
    """Edges (a, b) between the least class of each doc_id and its others."""
    known = profiles.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "cls")
    several = known.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("last")).where("b < last")
    return known.join(several, "doc_id").select(F.col("cls").alias("a"), "b").where("a <> b").distinct()


def grouped(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, by_id: bool = True) -> DataFrame:
    """doc_id, hash (of the text), n (size of the set) and label (equal for rows that links connect) for every row of docs.

    by_id: rows of one doc_id are connected, too. label is null for rows without doc_id or without words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    profiles = staged(texts.mapInPandas(_profiles(width, percent), "doc_id long, hash long, n long, cls long, e long, tokens array<long>"), "profiles")
    documents = profiles.select("doc_id", "hash", "n", "cls")
    classes = profiles.where("doc_id IS NOT NULL AND n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("e").alias("e"))
    rows = profiles.select(F.explode("tokens").alias("token"), "cls")
    hot = staged(_hot(rows), "hot")
    few = F.broadcast(hot)  # at most HOT_SAMPLE / HOT rows
    with batch_rows(spark, 50_000):
        cold = rows.join(few, "token", "left_anti").repartition("token").sortWithinPartitions("token", "cls")
        cold = cold.mapInPandas(_shared, "token long, cls long, df int").withColumn("hot", F.lit(False))
        warm = rows.join(few, "token").select("token", "cls", "df", F.lit(True).alias("hot"))
        own = cold.union(warm).groupBy("cls").agg(F.collect_set(F.struct("df", "token", "hot")).alias("shared")).join(classes, "cls")
        own = own.withColumn("take", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("e") - F.size("shared"))).where("take > 0")
        rare = own.select(F.explode(F.slice(F.sort_array("shared"), F.lit(1), F.col("take").cast("int"))).alias("x"), "cls", "n")
        rare = staged(rare.select("x.token", "x.hot", "cls", "n"), "rare")
        cold = rare.where("NOT hot").select("token", "n", "cls").repartition("token").sortWithinPartitions("token", "n", "cls")
        # hubs for each hot shingle: the least class of each scale that has it, and an edge to that of the next scale
        # (scales are a little wider than a link allows, so rounding can't set two that link two scales apart)
        scale = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-6))).cast("int")
        sized = rare.where("hot").select("token", "cls", scale.alias("scale"))
        hubs = sized.groupBy("token", "scale").agg(F.min("cls").alias("b"))
        warm = sized.join(F.broadcast(hubs), ["token", "scale"]).select(F.col("cls").alias("a"), "b")
        beside = hubs.select("token", (F.col("scale") + 1).alias("scale"), F.col("b").alias("a")).join(hubs, ["token", "scale"]).select("a", "b")
        stars = staged(cold.mapInPandas(_steps(percent), "a long, b long").union(warm).union(beside).where("a <> b"), "stars")
    drop(hot)
    found = components(stars)
    hoods = staged(found.select(F.col("node").alias("cls"), F.col("label").alias("hood")), "hoods")
    drop(found)
    drop(stars)
    classes = classes.select("cls", "doc_id", "n")
    members = _blocks(hoods.join(classes, "cls"), "n", "cls")
    rows = _with_sets(texts, members.select("doc_id", "cls", "hood", "block", F.col("cls").alias("label")), members.count(), width)
    links = _links(rows.withColumn("task", F.xxhash64("hood", "block")), percent)
    links = staged(links.union(_ids_as_links(profiles)) if by_id else links, "links")
    found = components(links)
    done = [profiles, hoods, members, links, found, rare]
    wide = members.groupBy("hood").agg(F.max("block").alias("last")).where("last > 0")
    if not wide.isEmpty():
        known = staged(found, "known")
        a, b = members.join(wide.select("hood"), "hood", "left_semi").drop("block").alias("a"), known.alias("b")
        again = a.join(b, F.col("a.cls") == F.col("b.node"), "left").select("a.*", F.coalesce("b.label", "a.cls").alias("label"))
        again = _blocks(again, "label", "n", "cls")
        tops = again.groupBy("hood", "block").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"))
        x, y = tops.alias("x"), tops.alias("y")
        open_ = (F.col("x.first") != F.col("x.last")) | (F.col("y.first") != F.col("y.last")) | (F.col("x.first") != F.col("y.first"))
        sized = 100 * F.least("x.high", "y.high") >= percent * F.greatest("x.low", "y.low")
        pairs = x.join(y, (F.col("x.hood") == F.col("y.hood")) & (F.col("x.block") <= F.col("y.block"))).where(open_ & sized)
        pairs = _meeting(pairs.select(F.col("x.hood").alias("hood"), F.col("x.block").alias("one"), F.col("y.block").alias("other")), rare, again)
        pairs = pairs.select("hood", F.xxhash64("hood", "one", "other").alias("task"), F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))
        rows = _with_sets(texts, again.select("doc_id", "cls", "hood", "block", "label"), again.count(), width).join(pairs, ["hood", "block"])
        found = components(links.union(_links(rows, percent)))
        done += [known, again, found]
    labels = documents.alias("d").join(found.alias("f"), F.col("d.cls") == F.col("f.node"), "left")
    # empty sets, all of class 0, and rows without id have no label: each is alone
    alone = F.col("d.doc_id").isNull() | (F.col("d.n") == 0)
    labels = staged(labels.select("d.doc_id", "d.hash", "d.n", F.when(~alone, F.coalesce("f.label", "d.cls")).alias("label")), "labels")
    for table in done:
        drop(table)
    return labels


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of docs."""
    labels = grouped(docs, percent, width)
    least = labels.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labels.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of texts that links connect, that of the least doc_id; rows without doc_id or words stay. Same columns.

    Different texts of one doc_id are documents of their own here, so none is lost. Of several rows that have the
    least doc_id and belong to one group, that with the least hash of its text stays; of rows equal in both, that
    with the least hash of all columns.
    """
    labels = grouped(docs, percent, by_id=False)
    first = labels.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "hash")).alias("k"))
    kept = staged(first.select("k.doc_id", F.col("k.hash").alias("__hash"), F.lit(True).alias("__kept")), "kept")
    known = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__hash"))
    # rows without words have no label, and all of them stay
    wordless = F.col("row.text").isNull() | ~F.rlike("row.text", F.lit(WORD))
    found = known.join(kept, ["doc_id", "__hash"], "left").where(F.col("__kept") | F.col("doc_id").isNull() | wordless)
    repeated = labels.where("label IS NOT NULL").groupBy("doc_id", "hash").count().where("count > 1")
    if not repeated.isEmpty():
        plain = [f"row.`{c}`" for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
        order = Window.partitionBy("doc_id", "__hash").orderBy(F.xxhash64(*plain))
        found = found.withColumn("__at", F.row_number().over(order)).where("__at = 1 OR __kept IS NULL")
    return found.select("row.*")
