"""Recursive rules over Spark DataFrames."""

from ruleloom.engine import Engine
from ruleloom.plans.text import ParseError, parse_atom, parse_program, parse_rule

__all__ = ["Engine", "ParseError", "parse_atom", "parse_program", "parse_rule"]
