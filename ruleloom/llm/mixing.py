"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Each document has a size (its words). The documents of a source are dealt to shards by a seeded hash of id and
   text; in a shard they lie on a line of words, in seeded order. A source with more than one in HOT of all words or rows
   has a number of shards of its own, by its words and rows, so shards are about equally large.
2. A source's target is its weight's share of the mix, at most MOST times its size; what is over is shared
   again by weight (water filling, in closed form over the sources).
3. The seats of the corpus, blocks of BLOCK words, go to the sources by highest quotients t / (2 k + 1), t being the
   source's target. A source's seats, as words, go to its shards in proportion to their lines by rounded running
   sums, so that nothing is lost however many shards there are.
4. A quota of so many words takes the whole line as often as it fits in and, in seeded order, as many of its m blocks
   once more as make up the rest; the last of them is cut. The seeded order is a permutation i -> (a i + b) mod m, so
   no block is sorted or stored; a is a unit modulo m, being the residue of one of PRIMES larger primes, drawn by the seed.
5. A document takes the words that the chosen blocks share with it.

Only sums for each source and shard meet, in running sums over GROUP shards and then over the groups; only rows of
sources (not of documents or shards) are ever in one task. Same rows, parameters and seed: same result, however the table
is partitioned.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, the last; a source
without words has target 0; repeated rows are documents of their own and lie side by side in one shard, as nothing tells
them apart; null and repeated ids are told apart by their texts; ties in the seeded order go by id, size and
text hash; texts of any length are counted whole; an empty table gives no rows; mix() ignores other columns and
mixed() passes them through, whatever their names.
"""

from __future__ import annotations

import random
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.staging import staged
from ruleloom.llm.text import WORD

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, 17
#: About so many words, or so many rows, lie in a shard.
SHARD_WORDS, SHARD_ROWS = 1 << 15, 1024
#: At most twice so many sources are looked up by broadcast; running sums go over groups of so many shards.
HOT, GROUP = 1024, 4096
PRIMES = 64


def _is_prime(n: int) -> bool:
    """By Miller and Rabin's test, which is exact with these bases for odd n below 3,215,031,751."""
    d, twos = n - 1, 0
    while not d & 1:
        d, twos = d >> 1, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


@cache
def primes(n: int = PRIMES) -> tuple[int, ...]:
    """Primes above 2**31, far apart. Lines have fewer blocks than that, so they divide none of their numbers."""
    draw = random.Random(n)
    starts = [draw.randrange(1 << 31, 3 << 30) | 1 for _ in range(n)]
    return tuple(next(p for p in range(s, s + 4000, 2) if _is_prime(p)) for s in starts)


def sized(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source, others, text_hash and size: the number of words of the whole text."""
    return docs.select("doc_id", "source", *others, F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), a row for each source.

    Sources in order of code points, null last, have the weights in turn. A source is full when the common
    level (words for each unit of weight) reaches its cap; the level is found over the sources by the ratio of
    cap to weight, with running sums.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    df = sizes.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    df = df.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") + 1))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    ranked = Window.orderBy("ratio", F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "rest": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "total": F.sum("source_size").over(every) * F.lit(float(share))})
    # the level if just the sources before this one are full; the first that it doesn't fill is where it stays
    df = df.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    df = df.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every))
    return df.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def apportion(shares: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """Add quota: whole blocks for each row of shares (by, source, part) by highest quotients within each `by`.

    There are round(sum of parts / block) seats. Seats that a part surely gets are not listed: how far a quota
    can be from part / block is bounded by the part's proportion of (rows / 2 + 1), so that only the seats
    about it compete, fewer than 6 for each row and shard on average.
    """
    w = Window.partitionBy(by)
    df = shares.withColumns({"all": F.sum("part").over(w), "rows": F.count(F.lit(1)).over(w), "ideal": F.col("part") / block})
    df = df.withColumn("slack", F.when(F.col("all") > 0, F.ceil(F.col("part") / F.col("all") * (F.col("rows") / 2 + 1)) + 1).otherwise(F.lit(0)))
    df = df.withColumns({"sure": F.greatest(F.floor("ideal") - F.col("slack"), F.lit(0)).cast("long"), "last": (F.floor("ideal") + F.col("slack")).cast("long")})
    df = df.withColumn("open", F.round(F.col("all") / block).cast("long") - F.sum("sure").over(w))
    seats = df.where((F.col("part") > 0) & (F.col("last") >= F.col("sure"))).select(by, "source", "part", "open", F.explode(F.sequence("sure", "last")).alias("k"))
    seats = seats.withColumn("quotient", F.col("part") / (F.col("k") * 2 + 1))
    ranked = Window.partitionBy(by).orderBy(F.desc("quotient"), F.asc_nulls_last("source"), "k")
    won = seats.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= F.col("open")).groupBy(by, "source").agg(F.count(F.lit(1)).alias("won"))
    a, b = df.alias("a"), won.alias("b")
    same = (F.col(f"a.{by}") == F.col(f"b.{by}")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    return a.join(b, same, "left").select("a.*", (F.col("a.sure") + F.coalesce("b.won", F.lit(0))).alias("quota")).drop("all", "rows", "ideal", "slack", "sure", "last", "open")


def spread(lines: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, shard, line, source_size, target and words, the quota of each line.

    A source's words are its quota of blocks, at most MOST times its size, with what goes beyond whole copies of it
    rounded to its own blocks at their mean length. Over its shards they add up to just that.
    """
    quotas = apportion(goals.select(F.lit(0).alias("corpus"), "source", "source_size", "target", F.col("target").alias("part")), "corpus", block)
    a, b = lines.alias("a"), quotas.alias("b")
    size = F.greatest(F.col("b.source_size"), F.lit(1).cast("long"))
    given = F.least(F.col("b.quota") * block, (F.col("b.source_size") * F.lit(MOST)).cast("long"))
    blocks, whole = F.ceil(size / block), F.floor(given / size) * size
    given = whole + F.round(F.round((given - whole) * blocks / size) * size / blocks).cast("long")
    df = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target", given.alias("all"))
    # running sums over the shards of a source: within groups of shards, and over the groups' sums
    df = df.withColumn("group", F.floor(F.col("shard") / GROUP))
    over = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy("source", "group").agg(F.sum("line").alias("of_group")).withColumn("before", F.coalesce(F.sum("of_group").over(over), F.lit(0)))
    a, b = df.alias("a"), groups.alias("b")
    df = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.group") == F.col("b.group"))).select("a.*", "b.before")
    running = Window.partitionBy("source", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("upto", F.sum("line").over(running) + F.col("before")).drop("group", "before")
    rate = F.col("all") / F.greatest(F.col("source_size"), F.lit(1))
    return df.withColumn("words", (F.floor(F.col("upto") * rate + 0.5) - F.floor((F.col("upto") - F.col("line")) * rate + 0.5)).cast("long")).drop("all", "upto")


def _chosen(start: Column, size: Column, line: Column, words: Column, prime: Column, shift: Column, block: int) -> tuple[Column, Column]:
    """What a quota of words takes of the document at [start, start + size) of a line: whole copies, and ranges of words.

    The ranges, structs of begin and end within the document, ascend and don't touch.
    """
    blocks, length = F.greatest(F.ceil(line / block).cast("long"), F.lit(1).cast("long")), F.greatest(line, F.lit(1).cast("long"))
    whole = F.floor(words / length).cast("long")
    rest = words - whole * line
    # a unit of the residues: the prime is larger than any number of blocks, so it divides none of them
    stride = prime % blocks
    place = lambda i: (i * stride + shift) % blocks
    end, last = start + size, blocks - 1
    # the last block is short, so those after it come earlier by what it lacks
    before = lambda i: place(i) * block - F.when(place(last) < place(i), blocks * block - line).otherwise(F.lit(0).cast("long"))
    piece = lambda i: F.struct((F.greatest(start, i * block) - start).alias("begin"), (F.least(end, (i + 1) * block, i * block + rest - before(i)) - start).alias("end"))
    pieces = F.filter(F.transform(F.sequence(F.floor(start / block).cast("long"), F.floor((end - 1) / block).cast("long")), piece), lambda x: x["end"] > x["begin"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(whole), F.when((size == 0) | (rest == 0), none).otherwise(_joined(pieces, none))


def _joined(pieces: Column, none: Column) -> Column:
    """Ascending ranges, with those that touch made one."""
    def add(runs: Column, x: Column) -> Column:
        touches = F.coalesce(F.element_at(runs, -1)["end"] == x["begin"], F.lit(False))
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(F.element_at(runs, -1)["begin"].alias("begin"), x["end"].alias("end"))))
        return F.when((F.size(runs) > 0) & touches, grown).otherwise(F.concat(runs, F.array(x)))

    return F.aggregate(pieces, none, add)


def _taken(docs: DataFrame, *others: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, others, size, source_size, target, whole copies and ranges for every document."""
    sizes = staged(sized(docs, *others), "mixing")
    counts = staged(sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "sources")
    every = counts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    hot = counts.where((F.col("words") * HOT > every["words"]) | (F.col("rows") * HOT > every["rows"]))  # at most 2 * HOT
    hot = hot.select(F.col("source").alias("hot_source"), F.greatest(F.ceil(F.col("words") / shard_words), F.ceil(F.col("rows") / SHARD_ROWS)).alias("own_shards"))
    common = max(1, -(-every["words"] // HOT // shard_words), -(-every["rows"] // HOT // SHARD_ROWS))
    shards = F.greatest(F.coalesce("own_shards", F.lit(common)), F.lit(1))
    sizes = sizes.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("hot_source")) & F.col("own_shards").isNotNull(), "left")
    place = lambda k: F.xxhash64("doc_id", "text_hash", F.lit(seed + k))
    sizes = sizes.withColumns({"order": place(0), "shard": F.pmod(place(1), shards).cast("long")}).drop("hot_source", "own_shards")
    lines = sizes.groupBy("source", "shard").agg(F.sum("size").alias("line"))
    of_source = counts.select("source", F.col("words").alias("source_size"))
    quotas = spread(lines, targets(of_source, weights, share), block)
    w = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size", "text_hash", *others).rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("start", F.sum("size").over(w) - F.col("size"))
    p, q = placed.alias("p"), quotas.alias("q")
    joined = p.join(q, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard")))
    drawn = lambda k, n: F.pmod(F.xxhash64(F.coalesce("p.source", F.lit("")), F.col("p.shard"), F.lit(seed + k)), F.lit(n))
    prime = F.get(F.array(*[F.lit(p) for p in primes()]), drawn(3, PRIMES).cast("int"))
    whole, ranges = _chosen(F.col("p.start"), F.col("p.size"), F.col("q.line"), F.col("q.words"), prime, drawn(2, 1 << 31), block)
    return joined.select("p.doc_id", "p.source", *[f"p.{c}" for c in others], "p.size", "q.source_size", "q.target", whole.alias("whole"), ranges.alias("ranges"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    cut = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return _taken(docs, weights=weights, share=share, block=block, seed=seed, shard_words=shard_words).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + cut).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as whole copies are taken, and its chosen parts.

    Each run of words that the chosen blocks share with a document is a row of its own, so no text is put together
    from words that were apart; a run of all words is the whole text. Documents that the mix takes nothing of are
    absent. n_chars follows the text.
    """
    names = docs.columns
    h = F.xxhash64(*[c for c in names if "map<" not in docs.schema[c].dataType.simpleString()]).alias("h")
    taken = _taken(docs.select("doc_id", "source", "text", h), "h", **options)
    taken = taken.select("h", "size", "whole", "ranges").where((F.col("whole") > 0) | (F.size("ranges") > 0))
    # equal rows have equal hashes: one of them is kept and written for all, with what each of them takes
    first = F.row_number().over(Window.partitionBy("h").orderBy("h"))
    keyed = docs.select(F.struct("*").alias("row"), h).withColumn("n", first).where(F.col("n") == 1).drop("n")
    rows = keyed.join(taken, "h")
    text = F.col("row.text")
    parts = F.when(F.size("ranges") == 0, F.array().cast("array<string>")).when(F.element_at("ranges", 1)["end"] - F.element_at("ranges", 1)["begin"] == F.col("size"), F.array(text)).otherwise(words_at(text, F.col("ranges")))
    rows = rows.select("row", F.explode(F.concat(F.array_repeat(text, F.col("whole").cast("int")), parts)).alias("text"))
    out = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return rows.select(*out)


def words_at(text: Column, ranges: Column) -> Column:
    """The text of each range of words, from the beginning of its first word (of the text, if that is the first) to the end of its last."""
    after = F.split(text, f"(?<={WORD[:-1]})(?=[\\x20\\x09-\\x0D])")
    # each piece but the last ends with a word
    part = lambda w, r: F.array_join(F.slice(w, (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")), "")
    cut = lambda w, r: F.when(r["begin"] == 0, part(w, r)).otherwise(F.regexp_replace(part(w, r), "^[\\x20\\x09-\\x0D]+", ""))
    # an array of one, so that the text is split once for all its ranges
    return F.element_at(F.transform(F.array(after), lambda w: F.transform(ranges, lambda r: cut(w, r))), 1)
