"""Relational operators, rule bodies as joins, recursion and incremental maintenance."""
