"""Rule files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ruleloom.plans.rules import Program
from ruleloom.plans.text import parse_program


def read_program(spark: SparkSession, path: str) -> Program:
    """The rules of a text file (a program is small: its text is read by the driver)."""
    return parse_program("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
