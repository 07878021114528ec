"""Classification of ELH ontologies: completion rules over normalised axioms, run by the rule engine.

Axioms are brought to the normal forms A in B, A1 and A2 in B, A in some r.B,
some r.A in B, and r in s; the published completion rules then are Datalog over
relations of these, and their fixpoint is all subsumptions between named classes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..plans.model import Rule, atom, rule
from .expr import AllOf, Expr, Named, Some

TOP = "top"


class NotElh(ValueError):
    """An expression outside the language: only names, intersections and existentials."""


class Axioms:
    """Inclusions and role inclusions in normal form."""

    def __init__(self) -> None:
        self.isa: set[tuple[str, str]] = set()
        self.conj: dict[tuple[str, str], set[str]] = {}
        self.some_right: set[tuple[str, str, str]] = set()
        self.some_left: set[tuple[str, str, str]] = set()
        self.roles: set[tuple[str, str]] = set()
        self.names: set[str] = set()
        self._given: dict[Expr, str] = {}

    def name(self, e: Expr) -> str:
        """A name for an expression: its own, or a new one that is the same for equal expressions."""
        if isinstance(e, Named):
            self.names.add(e.iri)
            return e.iri
        return self._given.setdefault(e, f"_:e{len(self._given)}")

    def include(self, sub: Expr, sup: Expr) -> None:
        self.isa.add((self.left(sub), self.right(sup)))

    def left(self, e: Expr) -> str:
        """A name that holds wherever ``e`` does."""
        if isinstance(e, Named):
            return self.name(e)
        fresh, n = e not in self._given, self.name(e)
        if not fresh:
            return n
        if isinstance(e, AllOf):
            parts = [self.left(p) for p in e.parts]
            while len(parts) > 1:
                a, b, *rest = parts
                c = n if not rest else f"{n}.{len(rest)}"
                self.conj.setdefault((a, b), set()).add(c)
                parts = [c, *rest]
        elif isinstance(e, Some):
            self.some_left.add((e.prop, self.left(e.filler), n))
        else:
            raise NotElh(str(e))
        return n

    def right(self, e: Expr) -> str:
        """A name under which all that ``e`` says follows."""
        if isinstance(e, Named):
            return self.name(e)
        n = self.name(e)
        if isinstance(e, AllOf):
            self.isa |= {(n, self.right(p)) for p in e.parts}
        elif isinstance(e, Some):
            self.some_right.add((n, e.prop, self.right(e.filler)))
        else:
            raise NotElh(str(e))
        return n


def completion_rules(roles: Iterable[str], inclusions: Iterable[tuple[str, str]]) -> list[Rule]:
    out = [
        rule(atom("sub", "?x", "?b"), atom("sub", "?x", "?a"), atom("isa", "?a", "?b")),
        rule(atom("sub", "?x", "?c"), atom("conj1", "?n", "?a"), atom("conj2", "?n", "?b"), atom("conj3", "?n", "?c"), atom("sub", "?x", "?a"), atom("sub", "?x", "?b")),
    ]
    for r in roles:
        out.append(rule(atom(f"role {r}", "?x", "?b"), atom("sub", "?x", "?a"), atom(f"right {r}", "?a", "?b")))
        out.append(rule(atom("sub", "?x", "?c"), atom(f"role {r}", "?x", "?y"), atom("sub", "?y", "?b"), atom(f"left {r}", "?b", "?c")))
    out += [rule(atom(f"role {s}", "?x", "?y"), atom(f"role {r}", "?x", "?y")) for r, s in inclusions]
    return out


def classify(spark: SparkSession, inclusions: Iterable[tuple[Expr, Expr]], roles: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """All subsumptions (s, o) between different named classes."""
    ax = Axioms()
    for sub, sup in inclusions:
        ax.include(sub, sup)
    ax.roles |= set(roles)
    used = {r for _, r, _ in ax.some_right} | {r for r, _, _ in ax.some_left} | {r for pair in ax.roles for r in pair}
    every = ax.names | {x for pair in ax.isa for x in pair} | {f for _, _, f in ax.some_right}
    e = Engine(spark)

    def add(pred: str, pairs: Iterable[tuple[str, str]]) -> None:
        e.add_relation(pred, spark.createDataFrame(sorted(pairs), "s string, o string"))

    add("sub", {(x, x) for x in every})
    add("isa", ax.isa)
    keyed = [(f"c{i}", a, b, c) for i, ((a, b), heads) in enumerate(sorted(ax.conj.items())) for c in sorted(heads)]
    for k in (1, 2, 3):
        add(f"conj{k}", {(f"{x[0]} {x[3]}", x[k]) for x in keyed})
    for r in used:
        add(f"right {r}", {(a, b) for a, p, b in ax.some_right if p == r})
        add(f"left {r}", {(b, c) for p, b, c in ax.some_left if p == r})
    e.add_rules(completion_rules(sorted(used), sorted(ax.roles)))
    names = spark.createDataFrame([(n,) for n in sorted(ax.names)], "s string")
    found = e.relation("sub").where("s != o")
    return found.join(names, "s", "left_semi").join(names.withColumnRenamed("s", "o"), "o", "left_semi").select("s", "o")
