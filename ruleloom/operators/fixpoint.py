"""Least fixpoints by semi-naive rounds, and their maintenance under deletions and insertions.

A state is a dict from relation name to DataFrame. In a round all rules of a recursive group run on the rows that
were new in the round before; what they give and the state lacks is written to the shared folder, so plans stay short
and lost executors cost no more than a round. Relations are accumulated as unions of those tables and rewritten as
one after REWRITE rounds.

A chain rule, p(x, z) <- p(x, y), s(y, z) or its mirror image, over a step s that has one row at most for each value of
one of its columns, is closed by squaring: rows of p are extended by the steps s, s twice, s four times and so on, so
a chain of n steps takes log n rounds. Powers of such a step are no larger than it, and no row is derived over and over.
Many rows of a power may end at few values, as those of a tree do. Just the rows that go on from these are needed then, and
are broadcast to the power, so that neither is shuffled.

A step that branches may lead on without the rows that two of its other rows make up, such as short cuts past a node. They
make no difference to its closure, which is that of the rest then.

Pairs that meet after as many steps up a forest are those of one root and one number of steps. Just the members of such
generations are found and written, by walking up once, twice, four times and so on; the pairs are made where they are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.bodies import compile_rule
from ruleloom.operators.relations import LARGE, SMALL, difference, few, fresh, having, intersection, lacking, members, missing, relation, union, without
from ruleloom.pinning import both, counted, counted_where, rows_of, tables_of
from ruleloom.plans.analysis import heads, strata
from ruleloom.plans.rewrites import chain_step, closes, generations, linear_chain
from ruleloom.plans.rules import Program, Rule

State = dict[str, DataFrame]
REWRITE = 8
#: A step is shortened if it has at most so many pairs of rows that follow each other for each of its rows.
PAIRS = 4
#: Members of a generation in a block, and pairs that a task makes, about.
BLOCK, TASK = 4096, 1 << 26


class Evaluator:
    """Runs programs over states; schemas: column types of every relation."""

    def __init__(self, spark: SparkSession, schemas: dict[str, tuple[str, ...]], rewrite: int = REWRITE) -> None:
        self.spark, self.schemas, self.rewrite = spark, schemas, rewrite
        #: Paths of the tables written so far.
        self.made: set[str] = set()
        #: Relations that may hold rows which the rules at hand don't give.
        self.asserted: set[str] = set()

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        table, n = counted(df, name)
        self.made |= tables_of(table)
        return table, n

    def read(self, state: State, name: str) -> DataFrame:
        """The relation, empty if the state has none. A registered source may hold equal rows."""
        return getattr(state[name], "_source", state[name]) if name in state else relation(self.spark, self.schemas[name])

    def seen(self, state: State, views: list[Rule]) -> State:
        """The state with its views, each read through its rule; in order, so a view of a view is seen, too."""
        out = dict(state)
        for r in views:
            if all(a.symbol in out for a in r.body):
                out[r.head.symbol] = compile_rule(r, lambda _, atom: self.read(out, atom.symbol), self.schemas[r.head.symbol])
        return out

    def rule(self, rule: Rule, state: State, first: int | None = None, delta: State | None = None, others: State | None = None) -> DataFrame:
        """One rule; the atom at `first` reads delta, the others `others` (state, if not given)."""
        read = lambda i, atom: self.read(delta if i == first else others or state, atom.symbol)
        return compile_rule(rule, read, self.schemas[rule.head.symbol], first)

    def leads_on(self, state: State, step: str) -> bool:
        """Whether a counted binary relation has one row at most for each value of its first, or of its second column."""
        df = state.get(step)
        if df is None or rows_of(df) is None or len(self.schemas[step]) != 2 or len(set(self.schemas[step])) != 1:
            return False
        if not hasattr(df, "_leads_on"):
            # the column that has each value once
            df._leads_on = next((c for c in df.columns if df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").isEmpty()), None)
        return df._leads_on is not None

    def key(self, state: State, name: str, column: int) -> bool:
        """Whether a counted relation has one row at most for each value of a column, and no null there."""
        df, c = state.get(name), f"c{column}"
        if df is None or rows_of(df) is None:
            return False
        keys = df.__dict__.setdefault("_keys", {})
        if c not in keys:
            keys[c] = df.groupBy(c).count().where(F.col(c).isNull() | (F.col("count") > 1)).isEmpty()
        return keys[c]

    def single(self, rules: list[Rule], state: State, found: State) -> Rule | None:
        """The one recursive rule, if its head's values fix those of its body by keys of the other relations, and it reads its own once.

        So it makes a row of one body row only. null of the head isn't met by a join, and keys have none.
        """
        r = rules[0] if len(rules) == 1 else None
        if r is None or r.view or set(found) != {r.head.symbol} or sum(a.symbol == r.head.symbol for a in r.body) != 1:
            return None
        others = [a for a in r.body if a.symbol != r.head.symbol]
        if not all(a.positive and a.symbol in state and rows_of(state[a.symbol]) is not None for a in r.body):
            return None
        fixed, every = set(r.head.variables), {v for a in r.body for v in a.variables}
        while True:
            more = {v for a in others if set(a.variables) - fixed for i, t in enumerate(a.terms) if t in fixed and self.key(state, a.symbol, i) for v in a.variables} - fixed
            if not more:
                return r if fixed == every else None
            fixed |= more

    def grow_apart(self, rule: Rule, state: State, found: State) -> State:
        """grow() by one rule of single(): what a round makes is distinct, and no other round makes it, so it meets just the rows from before."""
        name, total, rounds = rule.head.symbol, [], 0
        at = next(i for i, a in enumerate(rule.body) if a.symbol == name)
        before, new = state[name], found[name]
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        while True:
            # a row can make many: few rows are dealt out first, and what they make stays so
            if rows_of(new) <= LARGE:
                new = new.repartition(parts, *new.columns)
            df = self.rule(rule, state, at, {name: new})
            df = without(df, before) if rows_of(before) is not None and rows_of(before) <= SMALL else missing(df, before)
            new, n = self.counted(df, "round")
            if not n:
                return {name: reduce(DataFrame.union, total)} if total else {}
            total.append(new)
            self.added(state, {name: new}, rounds)
            rounds += 1

    def shortened(self, step: DataFrame) -> DataFrame | None:
        """A counted binary relation less rows that two others make up; None if there are none, or too many pairs to look for them.

        It has the same closure, loops or not: both rows that one is left out for stay. A row that is made up of such as might be
        left out themselves stays, too.
        """
        ways = lambda c, n: step.groupBy(F.col(c).alias("_at")).agg(F.count(F.lit(1)).alias(n))
        pairs = ways("c1", "_in").join(ways("c0", "_out"), "_at").agg(F.sum(F.col("_in").cast("double") * F.col("_out"))).first()[0] or 0
        if pairs > PAIRS * rows_of(step):
            return None
        two = lambda df: fresh(df).withColumnRenamed("c1", "_m").join(fresh(df).withColumnRenamed("c0", "_m"), "_m").select("c0", "c1")
        made, n = self.counted(fresh(step).join(two(step), ["c0", "c1"], "left_semi"), "made")
        if not n:
            return None
        rest, _ = self.counted(missing(step, made), "rest")
        stay, n = self.counted(made.join(two(rest), ["c0", "c1"], "left_anti"), "rest")
        return both(rest, stay) if n else rest

    def over_shortened(self, rules: list[Rule], state: State) -> tuple[list[Rule], set[str]]:
        """The rules, closures of a step that branches over the step as shortened if that leads on; the state and the schemas get such steps, whose names come, too."""
        rules, derived, names = list(rules), heads(tuple(rules)), set()
        for p in sorted(derived - self.asserted):
            step = closes(tuple(rules), p)
            if step in derived or step not in state or rows_of(state[step]) is None or self.schemas[step] != self.schemas[p] or len(set(self.schemas[p])) != 1 or self.leads_on(state, step):
                continue
            if (df := self.shortened(state[step])) is not None:
                name = f"{step} shortened for {p}"
                state[name], self.schemas[name] = df, self.schemas[step]
                names.add(name)
                if self.leads_on(state, name):
                    rules = [Rule(r.head, tuple(a.named(name) if a.symbol == step else a for a in r.body)) if r.head.symbol == p else r for r in rules]
        return rules, names

    def led_around(self, edges: DataFrame, step: DataFrame, closure: DataFrame) -> tuple[DataFrame, int]:
        """The counted edges without those whose ends a step that lacks them still connects, and their number.

        Ways around are looked for from the edges on, among what led to their ends when they were there (the closure then). Those
        found are of REWRITE rows at most, and none is looked for among more rows than the step has; edges that stay may have one.
        """
        ahead, (rest, n) = edges.withColumn("_at", F.col("c0")), (edges, rows_of(edges))
        seen = ahead
        for i in range(self.rewrite):
            if i > 1:
                ends, _ = self.counted(ahead.select(F.col("_at").alias("c0"), "c1").distinct(), "ends")
                ahead = fresh(ahead).join(members(ends, closure).withColumnRenamed("c0", "_at"), ["_at", "c1"], "left_semi")
                ahead, _ = self.counted(ahead.select("c0", "c1", "_at"), "ahead")
            last = F.broadcast(fresh(ahead)) if rows_of(ahead) is None or few(ahead) else fresh(ahead)
            onward = fresh(step).toDF("_at", "_to").join(last, "_at").select("c0", "c1", F.col("_to").alias("_at"))
            ahead, m = self.counted(lacking(onward, seen), "ahead")
            if not m or m > rows_of(step):
                break
            rest, n = self.counted(fresh(rest).join(ahead.where("_at = c1"), ["c0", "c1"], "left_anti"), "lost")
            if not n:
                break
            seen = seen.union(ahead)
            ahead, _ = self.counted(fresh(ahead).join(fresh(rest), ["c0", "c1"], "left_semi"), "ahead")
        return rest, n

    def paired(self, group: list[str], rules: list[Rule], state: State) -> DataFrame | None:
        """The rows of the one relation of a group if it holds the pairs of each generation of a counted forest; None otherwise.

        A generation is dealt to blocks, and the pairs of blocks to tasks, so none is met as a whole. Over LARGE rows aren't written.
        """
        name = group[0]
        step, low = (generations(tuple(rules), name) if len(group) == 1 and name not in state else None) or (None, 0)
        if step not in state or self.schemas[step][low] != self.schemas[step][1 - low] or self.schemas[name] != self.schemas[step] or not self.key(state, step, low):
            return None
        # each value with the last one that it leads up to, or that of some steps, and their number
        walk, left = fresh(state[step]).select(F.col(f"c{low}").alias("c0"), F.col(f"c{1 - low}").alias("_top"), F.lit(1).cast("long").alias("_n")).where("_top IS NOT NULL"), None
        while left != 0:
            on = walk.select(F.col("c0").alias("_top"), F.col("_top").alias("_to"), F.col("_n").alias("_more"))
            further = walk.join(on, "_top", "left").select("c0", F.coalesce("_to", "_top").alias("_top"), (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("_n"), F.col("_to").isNotNull().alias("_on"))
            before, (walk, _, left) = left, counted_where(further, "walk", "_on")
            self.made |= tables_of(walk)
            # fewer go on each time, but those that lead to a loop
            if left and left == before:
                return None
            walk = walk.drop("_on")
        sizes, _ = self.counted(walk.groupBy("_top", "_n").agg(F.count(F.lit(1)).alias("_size")), "sizes")
        total = int(sizes.agg(F.sum(F.expr("CAST(_size AS DECIMAL(19)) * _size"))).first()[0] or 0)
        if not total:
            return None
        large, n = self.counted(sizes.where(F.col("_size") > BLOCK), "sizes")
        parts = F.ceil(F.col("_size") / BLOCK).cast("int")
        walk = walk.join(F.broadcast(large) if n and few(large) else large, ["_top", "_n"], "left").withColumn("_parts", F.coalesce(parts, F.lit(1)))
        walk = walk.withColumn("_part", F.pmod(F.xxhash64("c0"), F.col("_parts")).cast("int"))
        blocks, _ = self.counted(walk.groupBy("_top", "_n", "_parts", "_part").agg(F.collect_list("c0").alias("_all")), "blocks")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism, total // TASK + 1)
        others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        keys = ["_top", "_n", "_i", "_j"]
        # one side's members go one by one: Spark holds all that generators make of a joined row before it hands them on
        first = fresh(blocks).select("_top", "_n", "_parts", F.col("_part").alias("_i"), F.explode("_all").alias("c0"))
        first = first.select("_top", "_n", "_i", others.alias("_j"), "c0").repartition(tasks, *keys)
        second = fresh(blocks).select("_top", "_n", others.alias("_i"), F.col("_part").alias("_j"), F.col("_all").alias("_second")).repartition(tasks, *keys)
        pairs = first.join(second.hint("merge"), keys).select("c0", F.explode("_second").alias("c1"))
        if total <= LARGE:
            return self.counted(pairs, "round")[0]
        pairs._rows, pairs._tables = total, tables_of(blocks)
        return pairs

    def chained(self, rules: list[Rule], state: State) -> tuple[list[Rule], dict[str, Rule]]:
        """The rules, closures of a step that leads on in their linear form, and for each relation the chain rule to square."""
        rules, derived = list(rules), heads(tuple(rules))
        for p in sorted(derived - self.asserted):
            if (found := linear_chain(tuple(rules), p)) and (step := chain_step(Rule(found[1].head, found[1].body))) not in derived and self.leads_on(state, step):
                rules[rules.index(found[0])] = found[1]
        chains: dict[str, Rule] = {}
        for r in rules:
            step = chain_step(r)
            if step and step not in derived and r.head.symbol not in chains and self.schemas[step] == self.schemas[r.head.symbol] and self.leads_on(state, step):
                chains[r.head.symbol] = r
        return rules, chains

    def whole(self, rules: list[Rule], chains: dict[str, Rule], found: State) -> set[str]:
        """The relations of chain rules that hold just the rows of the step so far, none of them a loop or with nulls."""
        out = set()
        for p in chains.keys() & found.keys() - self.asserted:
            own, step = [r for r in rules if r.head.symbol == p and r != chains[p]], chain_step(chains[p])
            base = own[0].body[0] if len(own) == 1 and len(own[0].body) == 1 else None
            if base and base.positive and base.symbol == step and base.terms == own[0].head.terms and len(base.variables) == 2:
                if found[p].where("c0 = c1 OR c0 IS NULL OR c1 IS NULL").isEmpty():
                    out.add(p)
        return out

    def ends(self, power: DataFrame, way: str, rows: int, steps: int) -> DataFrame | None:
        """The values at which a power ends, if they are few and less than half of some rows go on from there; their column is `way`.

        way: the column in which the power, and the rows for each number of steps up to `steps`, have each value once.
        """
        far = "c1" if way == "c0" else "c0"
        n = power.agg(F.approx_count_distinct(far)).first()[0]
        if n > LARGE or 2 * n * steps > rows:
            return None
        ends, _ = self.counted(power.select(F.col(far).alias(way)).distinct(), "ends")
        return ends if few(ends) else None

    def onward(self, power: DataFrame, way: str, rows: DataFrame, steps: int, ends: DataFrame | None) -> DataFrame:
        """The power's steps and then rows, or before them if its second column has each value once; see ends()."""
        if ends is not None:
            rows = fresh(rows).join(F.broadcast(fresh(ends)), way, "left_semi").select("c0", "c1")
            if rows_of(ends) * steps <= LARGE:
                rows, _ = self.counted(rows, "part")
                rows = F.broadcast(rows) if few(rows) else rows
        first, second = (power, rows) if way == "c0" else (rows, power)
        return first.select("c0", F.col("c1").alias("_m")).join(second.select(F.col("c0").alias("_m"), "c1"), "_m").select("c0", "c1")

    def doubled(self, power: DataFrame, way: str, rest: DataFrame | None, steps: int, rows: int) -> list[tuple[DataFrame, int, int]]:
        """The power of twice its steps, and then that of the rows of fewer steps if there are any: written, with numbers of rows and of loops."""
        ends = self.ends(power, way, rows, steps) if rows > LARGE else None
        out = []
        for df, most in ((power, 1), (rest, steps - 1)):
            if df is not None:
                out.append(counted_where(self.onward(power, way, df, most, ends), "round", "c0 = c1"))
                self.made |= tables_of(out[-1][0])
        return out

    def closed(self, chains: dict[str, Rule], rows: State, state: State, known: State, whole: set[str] | frozenset[str] = frozenset(), among: State | None = None) -> tuple[State, State]:
        """rows with all that chain rules make of them over the steps of the state, and that alone; known (which holds rows) gets it, too.

        A row that known has already isn't extended: what follows from it is known, or follows from other changes.
        whole: of these, known is rows and rows are the step. A value has one way on (or back) there, so a row can come twice only
        by a way around a loop, and then one round at the latest makes a row of two equal values. Up to that round nothing has to be
        told apart.
        """
        out, more = dict(rows), {}
        for p in chains.keys() & rows.keys():
            rule, step, rest, steps = chains[p], chain_step(chains[p]), None, 1
            power, own, way = state[step], next(i for i, a in enumerate(chains[p].body) if a.symbol == p), state[step]._leads_on
            while True:
                twice = None
                if p in whole:
                    # the rows are those of fewer steps and the power, whichever comes first, so its square is one of the tables
                    tables = self.doubled(power, way, rest, steps, rows_of(out[p]))
                    (twice, n, _), rest = tables[0], reduce(both, [out[p], *(t for t, m, _ in tables[1:] if m)])
                    found = {p: reduce(both, [t for t, m, _ in tables if m])} if any(m for _, m, _ in tables) else {}
                    whole = whole - {p} if any(loops for *_, loops in tables) else whole
                else:
                    read = lambda i, atom, r=out[p], s=power, own=own: r if i == own else s
                    found = {p: compile_rule(rule, read, self.schemas[p], own)}
                new = found if p in whole else self.new_rows(found, known, (rows_of(out[p]) or 0) > SMALL, among)
                if not new:
                    break
                known[p], out[p] = both(known[p], new[p]), both(out[p], new[p])
                more[p] = both(more[p], new[p]) if p in more else new[p]
                if twice is None:
                    # of each value there is one row at most, so equal rows can't come of it
                    twice, n = self.counted(self.onward(power, way, power, 1, None), "power")
                if not n:
                    break
                power, steps = twice, 2 * steps
        return out, more

    def from_changes(self, rules: list[Rule], changes: State, state: State, chains: dict[str, Rule] | None = None) -> State:
        """For each head what its rules give with one atom read from the changes and the rest from the state.

        The changes of relations with chain rules are closed under these already.
        """
        out: dict[str, list[DataFrame]] = {}
        rules, views = [r for r in rules if not r.view], [r for r in rules if r.view]
        if views:
            changes, state = self.seen(changes, views), self.seen(state, views)
        for r in rules:
            for i, atom in enumerate(r.body):
                closed = atom.symbol == r.head.symbol and (chains or {}).get(atom.symbol) == r
                if atom.positive and atom.symbol in changes and not closed:
                    out.setdefault(r.head.symbol, []).append(self.rule(r, state, i, changes, state))
        return {h: reduce(DataFrame.union, parts) for h, parts in out.items()}

    def new_rows(self, found: State, state: State, many: bool = False, among: State | None = None, sets: set[str] | frozenset[str] = frozenset()) -> State:
        """Written tables of the rows that the state lacks; relations without any are left out. many: it is known that they are many.

        among: holds all rows that may be new. sets: relations of which found has no row twice.
        """
        out = {}
        for name, df in found.items():
            if among is not None:
                if name not in among:
                    continue
                df, many = having(df, among[name]), True
            known = self.read(state, name)
            if name in sets and rows_of(known) == 0:
                pass
            elif (rows_of(known) or 0) > LARGE and not many:
                # a large relation isn't shuffled to be told apart from a few rows: those are written and broadcast to it
                df, n = self.counted(df.distinct(), "found")
                if not n:
                    continue
                df = difference(df, members(df, known)) if n <= SMALL else missing(df, known)
            else:
                df = lacking(df, known) if rows_of(known) != 0 else df.distinct()
            table, n = self.counted(df, "round")
            if n:
                out[name] = table
        return out

    def added(self, state: State, rows: State, rounds: int) -> None:
        for name, df in rows.items():
            # rows are new, so no distinct is needed
            state[name] = both(state[name], df) if name in state else df
            if rounds % self.rewrite == self.rewrite - 1:
                state[name], _ = self.counted(state[name], "total")

    def grow(self, rules: list[Rule], state: State, changes: State, whole: set[str] | frozenset[str] = frozenset(), among: State | None = None) -> State:
        """Add to the state all that follows from changes (which it holds already); returns what was added. whole: see closed().

        among: holds all rows that may be added, and those of changes, so what is found meets these instead of the state.
        """
        total: dict[str, list[DataFrame]] = {}
        rounds = 0
        rules, chains = self.chained(rules, state)
        known = state if among is None else dict(changes)
        while changes:
            changes, more = self.closed(chains, changes, state, known, frozenset() if rounds else whole, among)
            if known is not state:
                self.added(state, more, 0)
            changes = self.new_rows(self.from_changes(rules, changes, state, chains), known, False, among)
            self.added(state, changes, rounds)
            if known is not state:
                self.added(known, changes, rounds)
            for name, df in (*more.items(), *changes.items()):
                total.setdefault(name, []).append(df)
            rounds += 1
        return {name: reduce(DataFrame.union, parts) for name, parts in total.items()}

    def copies(self, rule: Rule, state: State) -> bool:
        """Whether the head's rows are those of one counted relation, which is a set, with its columns in some order."""
        atom = rule.body[0] if len(rule.body) == 1 else None
        return bool(atom and atom.positive and rows_of(self.read(state, atom.symbol)) is not None and len(atom.variables) == len(atom.terms) == len(rule.head.terms) and set(atom.terms) == set(rule.head.terms))

    def complete(self, program: Program, state: State) -> State:
        """Add to the state its least fixpoint, stratum by stratum; returns what was added."""
        out: State = {}
        views = [r for r in program if r.view]
        for group, rules in strata(program):
            # rules without a body state facts
            if not views and (pairs := self.paired(group, rules, state)) is not None:
                state.update({name: pairs for name in group})
                out.update({name: pairs for name in group})
                continue
            rules, helpers = (rules, set()) if views else self.over_shortened(rules, state)
            first, seen, sets = {}, self.seen(state, views) if views else state, set()
            for r in rules:
                if r.view or any(a.positive and rows_of(self.read(seen, a.symbol)) == 0 for a in r.body):
                    continue
                sets = sets - {r.head.symbol} if r.head.symbol in first or not self.copies(r, seen) else sets | {r.head.symbol}
                df = self.rule(r, seen) if r.body else relation(self.spark, self.schemas[r.head.symbol], [tuple(t.value for t in r.head.terms)])
                first[r.head.symbol] = first[r.head.symbol].union(df) if r.head.symbol in first else df
            found = self.new_rows(first, state, False, None, sets)
            self.added(state, found, 0)
            rules, chains = self.chained(rules, state)
            recursive = [r for r in rules if any(a.positive and a.symbol in group for a in r.body)]
            whole = self.whole(rules, chains, found) if len(group) == 1 and not views else set()
            if len(group) == 1 and not views and not chains and (rule := self.single(recursive, state, found)):
                more = self.grow_apart(rule, state, found)
            else:
                more = self.grow([*recursive, *(v for v in views if v not in recursive)], state, found, whole) if recursive else {}
            for name in {*found, *more}:
                parts = [x[name] for x in (found, more) if name in x]
                out[name] = reduce(DataFrame.union, parts)
            for name in helpers:
                del state[name], self.schemas[name]
        return out

    def lost(self, rules: list[Rule], chains: dict[str, Rule], explicit: State, state: State, gone: State) -> dict[str, State]:
        """For closures of a step that branches, the deleted rows of the step that no way around was found for."""
        out: dict[str, State] = {}
        if not any(r.view for r in rules):
            for p in heads(tuple(rules)) - chains.keys() - self.asserted:
                step = closes(tuple(rules), p)
                if step in gone and step not in heads(tuple(rules)) and p in state and self.schemas[step] == self.schemas[p] and rows_of(self.read(explicit, step)):
                    rest, n = self.led_around(gone[step], self.read(explicit, step), state[p])
                    out[p] = {step: rest} if n else {}
        return out

    def shrink(self, rules: list[Rule], explicit: State, state: State, gone: State) -> tuple[State, State]:
        """Delete explicit rows `gone` (no longer in explicit, still in the state) and what no longer follows.

        First all that has a derivation from a deleted row is marked, over the old state (which has all of it, being a
        fixpoint). Of the marked rows those that are explicit or follow in one step from what stays come back, and with
        them all that follows again; each rule is evaluated from the marked rows on. Returns (removed, came back).

        A deleted row of a step that branches marks nothing of its closure if other rows still connect its ends.
        """
        rules, chains = self.chained(rules, state)
        marked, changes, lost = dict(gone), gone, self.lost(rules, chains, explicit, state, gone)
        while changes:
            changes, _ = self.closed(chains, changes, state, marked)
            found = self.from_changes([r for r in rules if r.head.symbol not in lost], changes, state, chains)
            for p, instead in lost.items():
                found |= self.from_changes([r for r in rules if r.head.symbol == p], instead, state, chains)
            # the closures' rules read nothing else that was deleted, so they go as the others from here on
            changes, lost = self.new_rows(found, marked), {}
            for name, df in changes.items():
                marked[name] = both(marked[name], df) if name in marked else df
        for name, df in marked.items():
            state[name], _ = self.counted(without(state[name], df), "kept")
        back: State = {}
        for name, df in marked.items():
            again = [members(df, self.read(explicit, name))]
            seen = self.seen(state, [r for r in rules if r.view])
            for r in rules:
                if r.head.symbol == name and r.body:
                    again.append(compile_rule(Rule(r.head, (r.head, *r.body)), lambda i, atom, df=df, seen=seen: self.read(seen, atom.symbol) if i else df, self.schemas[name], 0))
                elif r.head.symbol == name:
                    again.append(intersection(df, relation(self.spark, self.schemas[name], [tuple(t.value for t in r.head.terms)])))
            table, n = self.counted(union(*again), "back")
            if n:
                back[name] = table
        self.added(state, back, 0)
        # no row is there that was not there before, so all that comes back was marked
        more = self.grow(rules, state, back, frozenset(), marked)
        returned = {name: reduce(DataFrame.union, [x[name] for x in (back, more) if name in x]) for name in {*back, *more}}
        removed = {name: difference(df, returned[name]) if name in returned else df for name, df in marked.items()}
        return removed, returned


def total_rows(state: State) -> int:
    """Rows of all relations, counted by one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in state.values()]
    return reduce(DataFrame.union, counts).agg(F.sum("n")).first()[0] if counts else 0
