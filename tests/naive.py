"""A naive evaluator over Python sets, to hold the engine's results against."""

from ruleloom.plans.analysis import strata
from ruleloom.plans.rules import Const, Var


def _same(a, b):
    return type(a) is type(b) and a == b


def _matches(atom, facts, binding):
    for row in facts.get(atom.symbol, ()):
        new = dict(binding)
        for term, value in zip(atom.terms, row, strict=True):
            want = term.value if isinstance(term, Const) else new.setdefault(term, value)
            if not _same(want, value):
                break
        else:
            yield new


def _derive(rule, facts):
    bindings = [{}]
    for atom in sorted(rule.body, key=lambda a: not a.positive):
        if atom.positive:
            bindings = [m for b in bindings for m in _matches(atom, facts, b)]
        else:
            bindings = [b for b in bindings if not any(True for _ in _matches(atom, facts, b))]
    return {tuple(b[t] if isinstance(t, Var) else t.value for t in rule.head.terms) for b in bindings}


def fixpoint(program, explicit):
    facts = {k: set(v) for k, v in explicit.items()}
    for _, rules in strata(program):
        while True:
            found = {}
            for r in rules:
                found.setdefault(r.head.symbol, set()).update(_derive(r, facts))
            before = sum(map(len, facts.values()))
            for k, rows in found.items():
                facts.setdefault(k, set()).update(rows)
            if sum(map(len, facts.values())) == before:
                break
    return facts
