"""Typed values of rules as Spark columns."""
