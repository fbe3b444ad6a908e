"""The engine: named relations, standing programs kept at their fixpoint, and ad-hoc queries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.values import NULLARY, literal, python_type, same_type
from ruleloom.operators.bodies import _scan
from ruleloom.operators.fixpoint import Evaluator, State, total_rows
from ruleloom.operators.relations import difference, members, positional, relation, union, without
from ruleloom.pinning import both, drop_paths, rows_of, tables_of
from ruleloom.plans.analysis import SchemaConflictError, check_safety, dependencies, heads, infer_schemas, recursive_groups, strata
from ruleloom.plans.rewrites import narrowed
from ruleloom.plans.rules import Atom, Program, Rule, alpha_equivalent
from ruleloom.plans.text import parse_atom, program_of

Rows = DataFrame | Iterable[tuple]


class Engine:
    """Relations are sets of rows with positional columns c0, c1, ... of fixed types.

    Explicit rows are those inserted or registered. The visible relation also holds what the standing program derives;
    it is kept at the least fixpoint after every change. Deleting a row that is derived but not explicit does nothing.

    Relations that a standing program or recursive rules read are written to the shared folder and counted once.
    Tables that a change leaves behind are removed at the next one, so a DataFrame taken from the engine, or returned
    by update(), has to be used before the second change after it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.explicit: State = {}
        self.visible: State = {}
        self.program: Program = ()
        #: Types of the relations that got rows, and of all that the program names.
        self.declared: dict[str, tuple[str, ...]] = {}
        self.schemas: dict[str, tuple[str, ...]] = {}
        self._made: set[str] = set()

    # relations

    def _rows(self, name: str, rows: Rows) -> DataFrame:
        """Rows as a DataFrame of the relation's types; fixes them for a new relation."""
        if isinstance(rows, DataFrame):
            df = positional(rows)
            types = () if df.columns == [NULLARY] else tuple(t for _, t in df.dtypes)
        else:
            rows = [tuple(r) for r in rows]
            if not rows:
                return relation(self.spark, self.schemas.get(name, ()))
            types = tuple(python_type(v) for v in rows[0])
            for r in rows:
                if tuple(python_type(v) for v in r) != types:
                    raise SchemaConflictError(f"rows of {name} differ in number or types of columns")
            df = relation(self.spark, types, rows)
        if self.declared.get(name, types) != types:
            raise SchemaConflictError(f"{name} has columns {self.declared[name]}, not {types}")
        if name not in self.declared:
            # columns that only the program named so far may get their types now
            self.schemas = infer_schemas(self.program, self.declared | {name: types})
            self.declared[name] = types
        return df

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame the explicit rows of a relation. Its source is read where rules need it.

        Rules that read it once read just the columns and rows that they need; equal rows go with what is derived.
        """
        if name in self.explicit:
            raise SchemaConflictError(f"{name} exists")
        source = self._rows(name, df)
        rows = source.distinct()
        rows._source = source
        if self.program:
            self._change({}, {name: rows})
        else:
            self.explicit[name] = self.visible[name] = rows

    def insert(self, name: str, *rows: tuple) -> None:
        self.update([(True, (name, r)) for r in rows])

    def delete(self, name: str, *rows: tuple) -> None:
        self.update([(False, (name, r)) for r in rows])

    def drop_relation(self, name: str) -> None:
        """Forget a relation. What the standing program derived from it goes, too."""
        self.schemas.pop(name, None)
        self.declared.pop(name, None)
        if not self.program:
            self.explicit.pop(name, None)
            self.visible.pop(name, None)
            return
        used = any(name in (r.head.symbol, *(a.symbol for a in r.body)) for r in self.program)
        self.explicit.pop(name, None)
        if used:
            self._rebuild(self.program, {name})
        else:
            self.visible.pop(name, None)

    def relation(self, name: str) -> DataFrame:
        """The visible rows; empty for a relation that only a rule names."""
        if name in self.visible:
            return self.visible[name]
        if name in self.schemas:
            return relation(self.spark, self.schemas[name])
        raise KeyError(name)

    def contains_row(self, name: str, row: tuple) -> bool:
        """Whether the row is visible; rows of other types, and unknown relations, are not."""
        df = self.visible.get(name)
        types = self.schemas.get(name, ())
        if df is None or len(types) != len(row) or not all(same_type(t, v) for t, v in zip(types, row, strict=True)):
            return False
        same = reduce(lambda a, b: a & b, [F.col(f"c{i}") == literal(v) for i, v in enumerate(row)], F.lit(True))
        return not df.where(same).isEmpty()

    def relation_counts(self) -> DataFrame:
        """relation, n: rows of every visible relation."""
        parts = [df.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n")) for name, df in sorted(self.visible.items())]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "relation string, n long")

    def count(self) -> int:
        """Rows of all visible relations together."""
        return total_rows(self.visible)

    # programs

    def _checked(self, program: Program) -> dict[str, tuple[str, ...]]:
        check_safety(program)
        strata(program)
        return infer_schemas(program, self.declared)

    def materialize(self, program: str | Rule | Iterable) -> None:
        """Add rules to the standing program and bring the visible relations to its fixpoint."""
        added = program_of(program)
        whole = (*self.program, *(r for r in added if not self._has(self.program, r)))
        self.schemas = self._checked(whole)
        self._pin({a.symbol for r in whole for a in r.body})
        if any(not a.positive for r in whole for a in r.body):
            self._rebuild(whole, {r.head.symbol for r in added})
            return
        self.program = whole
        run = Evaluator(self.spark, self.schemas)
        run.asserted = set(self.visible)
        run.complete(whole, self.visible)
        self._settle(run, run.made)

    def retract_rules(self, rules: str | Rule | Iterable) -> None:
        """Remove rules from the standing program, whatever their variables are called, and what only they derive."""
        gone = program_of(rules)
        self._rebuild(tuple(r for r in self.program if not self._has(gone, r)), {r.head.symbol for r in self.program if self._has(gone, r)})

    @staticmethod
    def _has(program: Program, rule: Rule) -> bool:
        return any(alpha_equivalent(rule, r) for r in program)

    def _rebuild(self, program: Program, changed: set[str]) -> None:
        """The fixpoint of the changed relations and of all that depend on them, from their explicit rows; others stay."""
        self.program = program
        self.schemas = infer_schemas(program, self.declared)
        reached = self._reached(changed)
        for name in reached:
            if name in self.explicit:
                self.visible[name] = self.explicit[name]
            else:
                self.visible.pop(name, None)
        run = Evaluator(self.spark, self.schemas)
        run.asserted = set(self.visible)
        run.complete(tuple(r for r in program if r.head.symbol in reached), self.visible)
        self._settle(run, run.made)

    def _pin(self, names: set[str]) -> None:
        """Write and count registered relations that will be read over and over."""
        run = Evaluator(self.spark, self.schemas)
        for name in names:
            if name in self.explicit and rows_of(self.explicit[name]) is None:
                table, _ = run.counted(self.explicit[name], "source")
                if self.visible[name] is self.explicit[name]:
                    self.visible[name] = table
                self.explicit[name] = table
        self._made |= run.made

    def _settle(self, run: Evaluator, keep: set[str]) -> None:
        """Show views as they are now, and remove the tables that neither a relation nor keep needs."""
        derived = heads(self.program)
        for name, df in self.visible.items():
            if name in self.explicit and name not in derived:
                self.visible[name] = self.explicit[name]
            elif len(tables_of(df)) > 2 * run.rewrite:
                self.visible[name], _ = run.counted(df, "total")
        views = [r for r in self.program if r.view]
        seen = run.seen(self.visible, views)
        for r in views:
            if r.head.symbol in seen:
                self.visible[r.head.symbol] = seen[r.head.symbol].distinct()
        live = keep.union(*(tables_of(df) for df in (*self.explicit.values(), *self.visible.values())))
        # what a view reads belongs to the relation below it
        made = self._made | run.made
        drop_paths(self.spark, made - live)
        self._made = made & live

    def update(self, changes: Iterable[tuple[bool, tuple[str, tuple]]] | dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Apply a signed batch: retractions first, then additions; a row with both is there afterwards.

        changes: (True to add, (relation, row)) in any order, or for each relation a DataFrame of rows and a
        last column _sign (positive to add, negative to retract). Returns (added, removed) of changed relations.
        """
        signed: dict[bool, State] = {True: {}, False: {}}
        if isinstance(changes, dict):
            for name, df in changes.items():
                rows = df.drop("_sign").columns
                for add in (True, False):
                    part = df.where(F.col("_sign") > 0 if add else F.col("_sign") < 0).select(*rows)
                    signed[add][name] = self._rows(name, part).distinct()
        else:
            by: dict[tuple[bool, str], list[tuple]] = {}
            for add, (name, row) in changes:
                by.setdefault((add, name), []).append(tuple(row))
            for (add, name), rows in by.items():
                if add or name in self.schemas:
                    signed[add][name] = self._rows(name, rows).distinct()
        return self._change(signed[False], signed[True])

    def _change(self, gone: State, more: State) -> dict[str, tuple[DataFrame, DataFrame]]:
        self._pin({*gone, *more})
        run = Evaluator(self.spark, self.schemas)
        asked = {k: run.counted(df, "asked") for k, df in gone.items() if k in self.explicit}
        gone = {k: t for k, (df, n) in asked.items() if n for t, m in [run.counted(members(df, self.explicit[k]), "gone")] if m}
        for name, df in gone.items():
            self.explicit[name], _ = run.counted(without(self.explicit[name], df), "explicit")
        before = {name: self.visible.get(name) for name in {*gone, *more, *heads(self.program)}}
        extra = run.new_rows(more, self.explicit)
        for name in more:
            self.explicit.setdefault(name, relation(self.spark, self.schemas[name]))
            self.visible.setdefault(name, relation(self.spark, self.schemas[name]))
        for name, df in extra.items():
            # a small addition is a table beside the others; many are written as one
            self.explicit[name] = both(self.explicit[name], df)
            if len(tables_of(self.explicit[name])) > run.rewrite:
                self.explicit[name], _ = run.counted(self.explicit[name], "explicit")
        if self._negates({*gone, *extra}):
            self._made |= run.made
            self._rebuild(self.program, {*gone, *extra})
            empty = lambda name: relation(self.spark, self.schemas[name])
            return {n: (difference(self.relation(n), before[n] if before.get(n) is not None else empty(n)), difference(before[n], self.relation(n)) if before.get(n) is not None else empty(n)) for n in before}
        out: dict[str, tuple[DataFrame, DataFrame]] = {}
        rules = list(self.program)
        run.asserted = set(self.explicit)
        removed: State = {}
        if gone:
            # rows that are asserted again in this batch stay explicit
            removed, _ = run.shrink(rules, self.explicit, self.visible, gone)
        # what no rule derives is just what is asserted
        derived = heads(self.program)
        fresh = {k: df for k, df in extra.items() if k not in derived} | run.new_rows({k: df for k, df in extra.items() if k in derived}, self.visible)
        run.added(self.visible, fresh, 0)
        grown = run.grow(rules, self.visible, fresh)
        for name in {*removed, *fresh, *grown}:
            parts = [x[name] for x in (fresh, grown) if name in x]
            plus = union(*parts) if parts else relation(self.spark, self.schemas[name])
            minus = removed.get(name, relation(self.spark, self.schemas[name]))
            out[name] = difference(plus, minus), difference(minus, plus)
        self._settle(run, run.made)
        return out

    def _reached(self, changed: set[str]) -> set[str]:
        """The changed relations and those that the standing program derives from them."""
        uses, reached = dependencies(self.program), set(changed)
        while more := {p for p, us in uses.items() if p not in reached and reached & set(us)}:
            reached |= more
        return reached

    def _negates(self, changed: set[str]) -> bool:
        """Whether some relation that the changed ones reach is read negated."""
        reached = self._reached(changed)
        return any(negated and q in reached for us in dependencies(self.program).values() for q, negated in us.items())

    def query(self, program: str | Rule | Iterable) -> dict[str, DataFrame]:
        """What a program derives besides the visible rows; the engine's relations stay as they are."""
        return self._evaluated(program)[1]

    def evaluate(self, program: str | Rule | Iterable) -> dict[str, DataFrame]:
        """All rows of the relations that a program derives, visible ones included."""
        state, _ = self._evaluated(program)
        return {name: state[name] for name in heads(program_of(program)) if name in state}

    def _evaluated(self, program: str | Rule | Iterable) -> tuple[State, State]:
        rules = program_of(program)
        schemas = infer_schemas((*self.program, *rules), self.declared)
        self._checked(rules)
        looping = {p for group in recursive_groups(rules) for p in group if len(group) > 1 or p in dependencies(rules)[p]}
        self._pin({a.symbol for r in rules if r.head.symbol in looping for a in r.body})
        run, state = Evaluator(self.spark, schemas), dict(self.visible)
        run.asserted = set(state)
        new = run.complete(rules, state)
        views = [r for r in rules if r.view]
        for r, seen in ((r, s) for s in [run.seen(state, views)] for r in views):
            state[r.head.symbol] = new[r.head.symbol] = seen[r.head.symbol].distinct()
        for name in heads(rules):
            new.setdefault(name, relation(self.spark, schemas[name]))
            state.setdefault(name, relation(self.spark, schemas[name]))
        return state, new

    def ask(self, goal: str | Atom, program: str | Rule | Iterable = ()) -> DataFrame:
        """The values of a goal's variables, a column for each, under the visible rows and a program.

        Only the rules that the goal depends on run, with the goal's constants in them where recursion passes them on.
        """
        goal = parse_atom(goal) if isinstance(goal, str) else goal
        rules = narrowed(self._relevant(program_of(program), goal.symbol), goal)
        state = self._evaluated(rules)[0] if rules else self.visible
        df = state[goal.symbol] if goal.symbol in state else self.relation(goal.symbol)
        return _scan(df, goal, {v: v.name for v in goal.variables}).distinct()

    @staticmethod
    def _relevant(program: Program, symbol: str) -> Program:
        """The rules that the symbol depends on."""
        uses, wanted, todo = dependencies(program), {symbol}, [symbol]
        while todo:
            for other in uses.get(todo.pop(), {}):
                if other not in wanted:
                    wanted.add(other)
                    todo.append(other)
        return tuple(r for r in program if r.head.symbol in wanted)
