"""Document fingerprints by winnowing, in DataFrame functions only.

The grams are runs of GRAM tokens, hashed with xxhash64 by doubling. Tokens are the words (white space as in the other
operators); of a word of more than LONG code points, such as a line of an unspaced script or encoded data, each code
point is a token. A text is padded with GRAM - 1 blank tokens on either side, so every non-empty text has a gram and
an edit at one end leaves the grams of the other end alone. Of each WINDOW consecutive grams the least hash is kept,
the rightmost of equal ones, with its position. Two texts that share WINDOW + GRAM - 1 tokens in a row therefore share
at least one kept hash, and the positions say where.

Edge cases: a null text counts as empty; a text without tokens has an empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0; texts of any length are hashed whole; repeated rows and ids are rows each, in
order of id (null first), then of a hash of the text, then of the text; a single row follows itself; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.staging import staged

GRAM = 4
#: A power of two: window minima are made by doubling.
WINDOW = 4
LONG = 24
#: Rows of a range of ids; larger tables have larger ranges, so that there are at most MOST_RANGES bounds to broadcast.
RANGE_ROWS, MOST_RANGES = 512, 1 << 20
_BLANK = "\\x20\\x09-\\x0D"


def tokens(text: Column) -> Column:
    """Words, and the code points of words of over LONG of them."""
    words = F.filter(F.split(text, f"[{_BLANK}]+"), lambda x: x != "")
    cut = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > LONG, F.split(x, "")).otherwise(F.array(x))))
    return F.when(F.rlike(text, F.lit(f"[^{_BLANK}]{{{LONG + 1}}}")), cut).otherwise(words)


def _paired(df: DataFrame, column: str, step: int, how) -> DataFrame:
    """column[i] = how(column[i], column[i + step])."""
    shifted = F.slice(column, F.lit(step + 1), F.greatest(F.size(column), F.lit(1)))
    return df.withColumn(column, F.zip_with(column, shifted, how))


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add column out: array<struct<hash: long, position: int>> of the kept grams, in order of position.

    gram and window are powers of two.
    """
    if gram & (gram - 1) or window & (window - 1):
        raise ValueError("gram and window must be powers of two")
    grams, least = f"__{out}_grams", f"__{out}_least"
    blanks = F.array_repeat(F.lit(0).cast("long"), gram - 1)
    df = df.withColumn(grams, F.transform(tokens(F.coalesce(text, F.lit(""))), lambda x: F.xxhash64(x)))
    df = df.withColumn(grams, F.when(F.size(grams) > 0, F.concat(blanks, grams, blanks)).otherwise(F.col(grams)))
    step = 1
    while step < gram:
        df = _paired(df, grams, step, lambda a, b: F.xxhash64(a, b))
        step *= 2
    df = df.withColumn(grams, F.slice(grams, 1, F.greatest(F.size(grams) - (gram - 1), F.lit(0))))
    df = df.withColumn(least, F.col(grams))
    step = 1
    while step < window:
        df = _paired(df, least, step, lambda a, b: F.least(a, b))
        step *= 2
    windows = F.greatest(F.size(grams) - (window - 1), F.least(F.size(grams), F.lit(1)))
    # a window keeps another gram than the one before if its least hash is another, or if its last gram ties with it
    new = lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)) | (F.get(least, i) == F.get(grams, i + (window - 1)))
    starts = F.when(windows > 0, F.filter(F.sequence(F.lit(0), windows - 1), new)).otherwise(F.array().cast("array<int>"))

    def kept(i: Column) -> Column:
        backwards = F.reverse(F.slice(grams, i + 1, F.lit(window)))
        at = i + F.size(backwards) - F.array_position(backwards, F.get(least, i)).cast("int")
        return F.struct(F.get(least, i).alias("hash"), at.alias("position"))

    return df.withColumn(out, F.transform(starts, kept)).drop(grams, least)


def hashes(fingerprint: str | Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def as_string(fingerprint: str | Column) -> Column:
    """hash:position of every kept gram, hash in hex, joined with spaces."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.hex(x["hash"]), x["position"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_next_text(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, hash, bucket, follows and head: of each row its range of ids and the text that comes after it.

    follows is the text of the next row in the range, or null in its last row, for which head is the first text of the
    range after it (of the first range, after the last). Ranges of about so many rows are cut from the sorted ids and text hashes
    alone; the texts are shuffled once, by range. What is broadcast is a few numbers for each of at most
    MOST_RANGES ranges (twice as many, as Spark sorts by samples). Equal rows share a range.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"))
    key = F.struct("doc_id", "hash")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = staged(docs.select("doc_id", "hash").repartitionByRange(parts, F.asc_nulls_first("doc_id"), "hash").withColumn("part", F.spark_partition_id()), "ids")
    rows = max(rows, -(-ids.count() // MOST_RANGES))
    ordered = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "hash")
    starts = ids.withColumn("at", F.row_number().over(ordered)).where((F.col("at") - 1) % rows == 0).select("part", key.alias("start")).distinct()
    # the first row of each part: as many as there are shuffle partitions
    firsts = [r["start"] for r in starts.groupBy("part").agg(F.min("start").alias("start")).orderBy("start").collect()]
    kind = docs.schema["doc_id"].dataType
    bounds = F.array(*[F.struct(F.lit(x["doc_id"]).cast(kind).alias("doc_id"), F.lit(x["hash"]).alias("hash")) for x in firsts or [{"doc_id": None, "hash": 0}]])
    coarse = lambda x: F.size(F.filter(bounds, lambda b: b <= x)) - 1
    fine = starts.select(coarse(F.col("start")).alias("coarse"), "start").groupBy("coarse").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    docs = docs.withColumn("coarse", coarse(key)).join(F.broadcast(fine), "coarse")
    bucket = F.col("coarse").cast("long") * (1 << 32) + F.size(F.filter("starts", lambda b: b <= key)) - 1
    docs = docs.withColumn("bucket", bucket).drop("coarse", "starts")
    # for each range the start of the next one, of which the least text is looked up
    after = F.transform("starts", lambda x, i: F.struct((F.col("coarse").cast("long") * (1 << 32) + i).alias("before"), F.coalesce(F.get("starts", i + 1), F.get(bounds, (F.col("coarse") + 1) % F.size(bounds))).alias("start")))
    after = fine.select(F.explode(after).alias("x")).select("x.before", F.col("x.start.doc_id").alias("next_id"), F.col("x.start.hash").alias("next_hash"))
    meets = F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("hash") == F.col("next_hash"))
    heads = docs.join(F.broadcast(after), meets).groupBy("before").agg(F.min("text").alias("head"))
    w = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "hash", "text")
    docs = docs.withColumn("follows", F.lead("text").over(w))
    return docs.join(heads, F.col("bucket") == F.col("before"), "left").select("doc_id", "text", "hash", "bucket", "follows", "head")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each whole text, its edited form and compare with the next document; see op10_winnow."""
    df = with_next_text(docs)
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring(F.coalesce("follows", "head"), F.lit(1), F.col("cut"))))
    df = df.withColumn("head", F.when(F.col("follows").isNull(), F.col("head"))).drop("follows")
    df = with_fingerprint(df, "text", "own")
    df = with_fingerprint(df, "edited", "other")
    df = df.withColumns({"edited_sha256": F.sha2("edited", 256), "own_set": hashes("own"), "other_set": hashes("other")}).drop("edited")
    w = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "hash", "text")
    df = df.withColumn("next_set", F.lead("own_set").over(w)).drop("text")
    df = with_fingerprint(df, "head", "ahead").withColumn("next_set", F.coalesce("next_set", hashes("ahead")))
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("own").alias("fingerprint"),
        as_string("other").alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("other_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
