"""Typed values: which Spark type a value or a source column has, and strict comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column of relations without columns: a row of it is the empty tuple.
NULLARY = "_u"
_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
_OF_PYTHON = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def type_of(kind: str) -> str:
    """The type that a source column of this type has in a relation."""
    return _WIDER.get(kind, kind)


def python_type(value: object) -> str:
    """The column type of a Python value; bool is no int here."""
    if type(value) not in _OF_PYTHON:
        raise TypeError(f"a fact holds str, bool, int and float, not {type(value).__name__}")
    return _OF_PYTHON[type(value)]


def same_type(kind: str, value: object) -> bool:
    """Whether a value can equal one of a column of this type: no casts, so 1, 1.0, true and '1' all differ."""
    return python_type(value) == kind


def literal(value: object) -> Column:
    return F.lit(value).cast(python_type(value))
