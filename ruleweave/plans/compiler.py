"""Bodies and heads of rules as DataFrame plans.

A body is a natural join of its atoms on their variables: scans with constants
pushed down, joins in a connected order that begins at the newest facts, builtins
as soon as their variables are bound, negated atoms as anti-joins at the end.
Catalyst takes it from there. Columns of the result are named by the variables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import Test
from .model import Atom, Builtin, Const, Rule, Term, Var

#: What a scan of an atom reads: columns ``s`` (class), ``s, o`` (property), or ``s, p, o`` (predicate variable).
Reader = Callable[[Atom], DataFrame]


def scan(atom: Atom, facts: DataFrame) -> DataFrame:
    """The matches of an atom: constants filtered, repeated variables equal, columns by variable."""
    places: list[tuple[str, Term]] = list(zip(("s", "o"), atom.args, strict=False))
    if isinstance(atom.pred, Var):
        places.append(("p", atom.pred))
    named: dict[str, str] = {}
    for column, t in places:
        if isinstance(t, Const):
            facts = facts.where(F.col(column) == F.lit(t.value))
        elif t.name in named:
            facts = facts.where(F.col(column) == F.col(named[t.name]))
        else:
            named[t.name] = column
    if not named:
        return facts.select(F.lit(True).alias("_true")).limit(1)
    return facts.select(*[F.col(column).alias(name) for name, column in named.items()])


def value(t: Term) -> Column:
    return F.col(t.name) if isinstance(t, Var) else F.lit(t.value)


def join_order(atoms: list[Atom], first: int | None = None) -> list[int]:
    """Places of the atoms so that each shares a variable with those before, where that can be; ``first`` leads."""
    left = list(range(len(atoms)))
    order = [first if first is not None else left[0]] if left else []
    left = [i for i in left if i not in order]
    bound = {v for i in order for v in atoms[i].vars}
    while left:
        # most shared variables, then fewest new ones: constants count as bound
        best = max(left, key=lambda i: (bool(bound & set(atoms[i].vars)), -len(set(atoms[i].vars) - bound), -i))
        order.append(best)
        left.remove(best)
        bound |= set(atoms[best].vars)
    return order


class Compiler:
    def __init__(self, builtins: Mapping[str, Test], domain: Callable[[], DataFrame] | None = None) -> None:
        self.builtins, self.domain = builtins, domain

    def body(self, rule: Rule, read: Reader, delta: int | None = None, read_delta: Reader | None = None) -> DataFrame:
        """Matches of the body; the positive atom number ``delta`` is read by ``read_delta`` and leads the join."""
        atoms = list(rule.positive)
        tests = list(rule.builtins)
        out: DataFrame | None = None
        bound: set[str] = set()
        for i in join_order(atoms, delta):
            a = atoms[i]
            new = scan(a, (read_delta if i == delta and read_delta else read)(a))
            if out is None:
                out = new
            elif shared := sorted(bound & set(a.vars)):
                out = out.join(new, shared)
            else:
                out = out.crossJoin(new)
            bound |= set(a.vars)
            out, tests = self._tested(out, tests, bound)
            if "_true" in out.columns and len(out.columns) > 1:
                out = out.drop("_true")
        for a in rule.negative:
            shared = sorted(bound & set(a.vars))
            if out is None:
                # nothing positive: the first argument ranges over all subjects
                first = next(t.name for t in a.args if isinstance(t, Var))
                assert self.domain is not None
                out, shared = self.domain().select(F.col("s").alias(first)).distinct(), [first]
                bound.add(first)
            new = scan(a, read(a))
            out = out.join(new.select(*shared).distinct(), shared, "left_anti") if shared else out.join(new.limit(1), F.lit(True), "left_anti")
        if out is None:
            raise ValueError(f"{rule}: nothing to read")
        out, tests = self._tested(out, tests, bound)
        if tests:
            raise ValueError(f"{rule}: {tests[0]} has unbound variables")
        return out

    def _tested(self, df: DataFrame, tests: list[Builtin], bound: set[str]) -> tuple[DataFrame, list[Builtin]]:
        ready = [t for t in tests if set(t.vars) <= bound]
        for t in ready:
            if t.name not in self.builtins:
                raise ValueError(f"no such builtin: {t.name}")
            df = df.where(self.builtins[t.name](*map(value, t.args)))
        return df, [t for t in tests if t not in ready]

    def with_invented(self, rule: Rule, matches: DataFrame) -> DataFrame:
        """One new node for each match of the body and invented variable, the same in every run."""
        for name in rule.invented:
            seen = [F.coalesce(F.col(v).cast("string"), F.lit("")) for v in sorted(rule.body_vars) if v in matches.columns]
            key = F.concat_ws("\x1f", F.lit(rule.name), F.lit(name), *seen)
            matches = matches.withColumn(name, F.concat(F.lit("_:n"), F.substring(F.sha2(key, 256), 1, 24)))
        return matches

    @staticmethod
    def head(atom: Atom, matches: DataFrame) -> DataFrame:
        """The facts of a head: columns ``s``, ``s, o``, or ``s, p, o`` for a predicate variable."""
        columns = [value(t).alias(n) for n, t in zip(("s", "o"), atom.args, strict=False)]
        if isinstance(atom.pred, Var):
            columns.insert(1, F.col(atom.pred.name).alias("p"))
        return matches.select(*columns)
