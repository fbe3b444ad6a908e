"""Terms, atoms and rules."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """A str, bool, int or float. Constants of different types are never equal: 1 is neither 1.0 nor true."""

    value: str | bool | int | float

    @property
    def type(self) -> str:
        return {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(self.value)]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Const) and self.type == other.type and self.value == other.value

    def __hash__(self) -> int:
        return hash((self.type, self.value))

    def __str__(self) -> str:
        if isinstance(self.value, bool):
            return str(self.value).lower()
        return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(self.value, str) else repr(self.value)


Term = Var | Const


@dataclass(frozen=True)
class Atom:
    symbol: str
    terms: tuple[Term, ...] = ()
    positive: bool = True

    @property
    def variables(self) -> tuple[Var, ...]:
        """Distinct variables in order of first appearance."""
        return tuple(dict.fromkeys(t for t in self.terms if isinstance(t, Var)))

    @property
    def is_ground(self) -> bool:
        return not self.variables

    def named(self, symbol: str) -> Atom:
        return replace(self, symbol=symbol)

    def __str__(self) -> str:
        return f"{'' if self.positive else '!'}{self.symbol}({', '.join(map(str, self.terms))})"


@dataclass(frozen=True)
class Rule:
    """A view's head holds just what its one rule gives: it is read through the rule, and no rows of its own are kept."""

    head: Atom
    body: tuple[Atom, ...] = ()
    view: bool = False

    def __str__(self) -> str:
        return f"{self.head} <- [{', '.join(map(str, self.body))}]"


Program = tuple[Rule, ...]


def _numbered(rule: Rule) -> Rule:
    """The rule with variables named by first appearance, head first."""
    names: dict[Var, Var] = {}
    rename = lambda a: replace(a, terms=tuple(names.setdefault(t, Var(str(len(names)))) if isinstance(t, Var) else t for t in a.terms))
    return replace(rule, head=rename(rule.head), body=tuple(rename(a) for a in rule.body))


def alpha_equivalent(a: Rule | Atom, b: Rule | Atom) -> bool:
    """Whether two rules or two atoms differ by the names of variables at most."""
    as_rule = lambda x: x if isinstance(x, Rule) else Rule(x)
    return isinstance(a, Rule) == isinstance(b, Rule) and _numbered(as_rule(a)) == _numbered(as_rule(b))


def unify(pattern: Atom, terms: tuple) -> dict[Var, Const] | None:
    """The values of the pattern's variables with which its terms become these, or None.

    Other terms are values; a variable among them goes with anything and gives no value.
    """
    if len(pattern.terms) != len(terms):
        return None
    found: dict[Var, Const] = {}
    for term, value in zip(pattern.terms, terms, strict=True):
        if isinstance(value, Var):
            continue
        value = value if isinstance(value, Const) else Const(value)
        if (term if isinstance(term, Const) else found.setdefault(term, value)) != value:
            return None
    return found


def substitute(atom: Atom, values: dict[Var, Const]) -> Atom:
    """The atom with known variables replaced by their values."""
    return replace(atom, terms=tuple(values.get(t, t) if isinstance(t, Var) else t for t in atom.terms))


def substituted(rule: Rule, values: dict[Var, Const]) -> Rule:
    return replace(rule, head=substitute(rule.head, values), body=tuple(substitute(a, values) for a in rule.body))
