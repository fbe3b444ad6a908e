"""A rule's body as one DataFrame: scans with filters, equi-joins on all shared variables, semi and anti joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.values import NULLARY, literal, same_type
from ruleloom.operators.relations import never
from ruleloom.pinning import rows_of
from ruleloom.plans.rules import Atom, Const, Rule, Var

#: Gives the relation that the i-th atom of a body reads.
Source = Callable[[int, Atom], DataFrame]


def join_order(rule: Rule, first: int | None = None, rows: Callable[[int], int | None] = lambda i: None) -> list[int]:
    """Places of the positive atoms: `first` (the changed one), then always an atom that shares a variable if there is one.

    Of atoms that share as many, the one of the smaller relation comes first, where rows() tells the sizes of both.
    """
    left = [i for i, a in enumerate(rule.body) if a.positive]
    order: list[int] = []
    bound: set[Var] = set()
    while left:
        if first in left:
            i = first
        else:
            shares = [i for i in left if bound & set(rule.body[i].variables)]
            constants = lambda i: sum(isinstance(t, Const) for t in rule.body[i].terms)
            i = max(shares or left, key=lambda i: (len(bound & set(rule.body[i].variables)), constants(i), -(rows(i) or 0), -i))
        order.append(i)
        left.remove(i)
        bound.update(rule.body[i].variables)
    return order


def _scan(df: DataFrame, atom: Atom, names: dict[Var, str]) -> DataFrame:
    """The atom's rows with a column for each of its variables; constants and repeated variables are filters."""
    first: dict[Var, int] = {}
    for i, term in enumerate(atom.terms):
        if isinstance(term, Const):
            df = df.where(F.col(f"c{i}") == literal(term.value) if same_type(df.dtypes[i][1], term.value) else never())
        elif term in first:
            df = df.where(F.col(f"c{i}") == F.col(f"c{first[term]}") if df.dtypes[i][1] == df.dtypes[first[term]][1] else never())
        else:
            first[term] = i
    if not first:
        return df.select(F.lit(1).alias(NULLARY)).limit(1)
    return df.select(*[F.col(f"c{i}").alias(names[v]) for v, i in first.items()])


def compile_rule(rule: Rule, source: Source, head_types: tuple[str, ...], first: int | None = None) -> DataFrame:
    """The head's rows, c0, c1, ..., not yet distinct. Columns that no later join and no head term needs are dropped."""
    names = {v: f"v{k}" for k, v in enumerate(dict.fromkeys(v for a in rule.body for v in a.variables))}
    order = join_order(rule, first, lambda i: rows_of(source(i, rule.body[i])))
    negative = [i for i, a in enumerate(rule.body) if not a.positive]
    out: DataFrame | None = None
    for step, i in enumerate(order):
        atom = rule.body[i]
        later = {v for k in (*order[step + 1 :], *negative) for v in rule.body[k].variables} | set(rule.head.variables)
        part = _scan(source(i, atom), atom, names)
        if out is None:
            out = part
        else:
            shared = [names[v] for v in atom.variables if names[v] in out.columns]
            kinds, others = dict(out.dtypes), dict(part.dtypes)
            if any(kinds[c] != others[c] for c in shared):
                part = part.where(never()).select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in part.dtypes])
            adds = any(v in later and names[v] not in out.columns for v in atom.variables)
            if not atom.variables or not shared:
                out = out.crossJoin(part.drop(NULLARY) if NULLARY in out.columns else part)
            else:
                out = out.join(part, shared, "inner" if adds else "left_semi")
        keep = [names[v] for v in later if names[v] in out.columns]
        out = out.select(*sorted(keep)) if keep else out.select(F.lit(1).alias(NULLARY))
    for i in negative:
        atom = rule.body[i]
        part = _scan(source(i, atom), atom, names)
        shared = [names[v] for v in atom.variables]
        if any(dict(out.dtypes)[c] != dict(part.dtypes)[c] for c in shared):
            continue
        out = out.join(part, shared, "left_anti") if shared else out.join(part.withColumnRenamed(NULLARY, "_n"), F.lit(True), "left_anti")
    if not rule.head.terms:
        return out.select(F.lit(1).alias(NULLARY))
    return out.select(*[(literal(t.value) if isinstance(t, Const) else F.col(names[t])).cast(kind).alias(f"c{k}") for k, (t, kind) in enumerate(zip(rule.head.terms, head_types, strict=True))])
