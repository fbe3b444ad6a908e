"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where a local session leaves it unset, a new local folder. A cluster has to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ruleloom-"))
    return found.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, a folder for each value of column `by`, and read it back.

    The table is dropped when the Python process ends; drop() removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ruleloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at, out._tables = path, frozenset([path])
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """staged(df) and its number of rows, seen while it is written; rows_of() tells it later."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    out._rows = seen.get["n"]
    return out, out._rows


def counted_where(df: DataFrame, name: str, condition: str) -> tuple[DataFrame, int, int]:
    """counted(df), and the number of rows that meet a condition."""
    seen = Observation()
    out, n = counted(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
    return out, n, seen.get["n"]


def rows_of(df: DataFrame) -> int | None:
    """The number of rows of a counted table, or of both() of such; None if it isn't known."""
    return getattr(df, "_rows", None)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of relations that share no row."""
    out = a.union(b)
    out._rows = None if rows_of(a) is None or rows_of(b) is None else rows_of(a) + rows_of(b)
    out._tables = tables_of(a) | tables_of(b)
    return out


def tables_of(df: DataFrame) -> frozenset[str]:
    """The paths of the staged tables that df, or both() of such, is made of."""
    return getattr(df, "_tables", frozenset())


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        _remove(spark, path)


def drop(df: DataFrame) -> None:
    """Remove a staged table that nothing will read any more."""
    _remove(df.sparkSession, df._staged_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
        pass
