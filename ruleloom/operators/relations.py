"""Set-valued relational operators over DataFrames with positional columns c0, c1, ...

Relations are sets: every operator that can make equal rows removes them. Columns of different types are never
equal; Spark would cast one of them, so such comparisons are decided before a plan is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.values import NULLARY, literal, same_type, type_of
from ruleloom.pinning import rows_of


def positional(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ..., integers widened to bigint and floats to double; a nullary relation keeps its unit column."""
    if df.columns == [NULLARY]:
        return df
    return df.select(*[F.col(f"`{name}`").cast(type_of(kind)).alias(f"c{i}") for i, (name, kind) in enumerate(df.dtypes)])


def relation(spark: SparkSession, types: tuple[str, ...], rows: list[tuple] = ()) -> DataFrame:
    """A relation from Python rows."""
    if not types:
        out = spark.createDataFrame([(1,)] * bool(rows), f"{NULLARY} int")
    else:
        out = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} {t}" for i, t in enumerate(types)))
    out._rows = len(rows)
    return out


def fresh(df: DataFrame) -> DataFrame:
    """The same relation with column identities of its own, for use beside itself in one plan."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def never() -> Column:
    return F.lit(False)


def select_value(df: DataFrame, column: int, value: object) -> DataFrame:
    """Rows whose column is the value; none if the types differ."""
    return df.where(F.col(f"c{column}") == literal(value) if same_type(df.dtypes[column][1], value) else never())


def select_equality(df: DataFrame, left: int, right: int) -> DataFrame:
    """Rows with equal values in two columns; none if the types differ."""
    return df.where(F.col(f"c{left}") == F.col(f"c{right}") if df.dtypes[left][1] == df.dtypes[right][1] else never())


def project(df: DataFrame, entries: list[int | Column]) -> DataFrame:
    """Columns by position, or literals, in any order and number; equal rows become one."""
    return df.select(*[(F.col(f"c{e}") if isinstance(e, int) else e).alias(f"c{i}") for i, e in enumerate(entries)]).distinct()


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    n = len(left.columns)
    return right.select(*[F.col(c).alias(f"c{n + i}") for i, c in enumerate(right.columns)])


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows: the meaning of a body whose atoms share no variable."""
    return left.crossJoin(_beside(left, right))


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[int, int]]) -> DataFrame:
    """Pairs of rows that agree on all pairs of columns; all columns of both."""
    n, other = len(left.columns), _beside(left, right)
    if any(left.dtypes[a][1] != right.dtypes[b][1] for a, b in on):
        return left.where(never()).join(other.where(never()))
    return left.join(other, reduce(lambda x, y: x & y, [F.col(f"c{a}") == F.col(f"c{n + b}") for a, b in on]))


def union(*relations: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, relations).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that right lacks; null equals null. One aggregation on whole rows also removes equal ones."""
    tagged = left.withColumn("_known", F.lit(0)).union(right.withColumn("_known", F.lit(1)))
    return tagged.groupBy(*left.columns).agg(F.max("_known").alias("_known")).where("_known = 0").drop("_known")


#: Relations of at most so many rows and bytes are sent to all executors to meet one of over LARGE rows, which then isn't shuffled.
SMALL, LARGE = 200_000, 1_000_000
SMALL_BYTES = 64 << 20


def _same(left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in left.columns])


def _meets(small: DataFrame, large: DataFrame) -> bool:
    """Whether counted relations differ so much in size that the small one should be broadcast."""
    return 0 < (rows_of(small) or 0) <= SMALL and (rows_of(large) is None or rows_of(large) > LARGE) and _bytes(small) <= SMALL_BYTES


def few(df: DataFrame) -> bool:
    """Whether a counted relation may be broadcast to spare a shuffle of over LARGE rows: strings may be longer in memory than in files."""
    return rows_of(df) <= (SMALL if any(t == "string" for _, t in df.dtypes) else LARGE) and _bytes(df) <= SMALL_BYTES


def _bytes(df: DataFrame) -> int:
    """Bytes of a relation as Spark estimates them: of staged tables those of the files, times two for being packed."""
    return 2 * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def members(small: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of a counted, mostly small relation that a mostly large one has."""
    if not _meets(small, large):
        return intersection(small, large)
    large, small = fresh(large), fresh(small)
    return large.join(F.broadcast(small), _same(large, small), "left_semi").distinct()


def without(large: DataFrame, small: DataFrame) -> DataFrame:
    """A mostly large relation (a set) less the rows of a counted, mostly small one."""
    if not _meets(small, large):
        return difference(large, small)
    large, small = fresh(large), fresh(small)
    return large.join(F.broadcast(small), _same(large, small), "left_anti")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; null equals null."""
    tagged = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select("*", F.lit(0), F.lit(1)))
    return tagged.groupBy(*left.columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).where("_l + _r = 2").drop("_l", "_r")


def lacking(found: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows of found that known lacks; known is read as it is and goes by broadcast if Spark finds it small."""
    return missing(found.distinct(), known)


def missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of a set that known lacks."""
    rows, known = fresh(rows), fresh(known)
    return rows.join(known, _same(rows, known), "left_anti")


def having(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows, equal ones as often as they come, that known has."""
    rows, known = fresh(rows), fresh(known)
    return rows.join(known, _same(rows, known), "left_semi")


def consolidate(changes: DataFrame, sign: str = "_sign") -> DataFrame:
    """Signed rows with the signs of equal rows added up, and those that cancel out removed."""
    rows = [c for c in changes.columns if c != sign]
    return changes.groupBy(*rows).agg(F.sum(sign).alias(sign)).where(F.col(sign) != 0)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two relations hold the same rows."""
    return difference(left, right).isEmpty() and difference(right, left).isEmpty()
