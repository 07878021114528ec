"""Rules as data: terms, atoms, conditions and rules, all immutable."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from ..terms import TYPE


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """A canonical term string, or a typed value where relations hold typed columns."""

    value: object

    def __str__(self) -> str:
        return str(self.value)


Term = Var | Const


@dataclass(frozen=True)
class Atom:
    """``pred(args)``: one argument for a class, two for a property; ``naf``: negation as failure."""

    pred: str | Var
    args: tuple[Term, ...]
    naf: bool = False

    def __str__(self) -> str:
        return ("not " if self.naf else "") + f"{self.pred}({', '.join(map(str, self.args))})"

    @property
    def vars(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for x in ((self.pred,) if isinstance(self.pred, Var) else ()) + self.args if isinstance(x, Var)))


@dataclass(frozen=True)
class Builtin:
    """A predicate on values that are bound elsewhere."""

    name: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"

    @property
    def vars(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for x in self.args if isinstance(x, Var)))


@dataclass(frozen=True)
class And:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Exists:
    names: tuple[str, ...]
    part: Condition


@dataclass(frozen=True)
class Not:
    """Negation of a condition, moved inwards by :func:`ruleweave.plans.normal.rules_of`."""

    part: Condition


Condition = Atom | Builtin | And | Or | Exists | Not


@dataclass(frozen=True)
class Rule:
    """heads :- body, the heads true together; ``name`` identifies it in explanations and invented nodes."""

    heads: tuple[Atom, ...]
    body: tuple[Atom | Builtin, ...]
    name: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        if not self.name:
            object.__setattr__(self, "name", "r" + hashlib.sha256(str(self).encode()).hexdigest()[:10])

    def __str__(self) -> str:
        return f"{' & '.join(map(str, self.heads))} :- {', '.join(map(str, self.body))}"

    @property
    def positive(self) -> tuple[Atom, ...]:
        return tuple(a for a in self.body if isinstance(a, Atom) and not a.naf)

    @property
    def negative(self) -> tuple[Atom, ...]:
        return tuple(a for a in self.body if isinstance(a, Atom) and a.naf)

    @property
    def builtins(self) -> tuple[Builtin, ...]:
        return tuple(a for a in self.body if isinstance(a, Builtin))

    @property
    def body_vars(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for a in self.body for v in a.vars))

    @property
    def invented(self) -> tuple[str, ...]:
        """Head variables that the body does not have: each match of the body makes a new node."""
        bound = {v for a in self.positive or self.negative for v in a.vars}
        return tuple(dict.fromkeys(v for h in self.heads for v in h.vars if v not in bound))


def v(name: str) -> Var:
    return Var(name)


def c(value: object) -> Const:
    return Const(value)


def term(x: object) -> Term:
    """``?name`` strings are variables, terms stay, anything else is a constant."""
    if isinstance(x, Var | Const):
        return x
    return Var(x[1:]) if isinstance(x, str) and x.startswith("?") else Const(x)


def atom(pred: str | Var, *args: object, naf: bool = False) -> Atom:
    return Atom(Var(pred[1:]) if isinstance(pred, str) and pred.startswith("?") else pred, tuple(map(term, args)), naf)


def cond(name: str, *args: object) -> Builtin:
    return Builtin(name, tuple(map(term, args)))


def rule(heads: Atom | Iterable[Atom], *body: Atom | Builtin, name: str = "") -> Rule:
    return Rule((heads,) if isinstance(heads, Atom) else tuple(heads), body, name)


def triple_atom(s: Term, p: Term, o: Term, naf: bool = False) -> Atom:
    """A triple pattern as an atom: ``x rdf:type C`` is C(x) for a ground class."""
    if isinstance(p, Var):
        return Atom(p, (s, o), naf)
    if p.value == TYPE and isinstance(o, Const):
        return Atom(str(o.value), (s,), naf)
    return Atom(str(p.value), (s, o), naf)


def renamed(rule: Rule, suffix: str) -> Rule:
    """The rule with all of its variables renamed apart."""

    def of(t: Term | str) -> Term | str:
        return Var(t.name + suffix) if isinstance(t, Var) else t

    def part(a: Atom | Builtin) -> Atom | Builtin:
        if isinstance(a, Builtin):
            return replace(a, args=tuple(map(of, a.args)))
        return replace(a, pred=of(a.pred), args=tuple(map(of, a.args)))

    return Rule(tuple(map(part, rule.heads)), tuple(map(part, rule.body)), rule.name)


def head_predicates(rules: Iterable[Rule]) -> Iterator[str | Var]:
    for r in rules:
        for h in r.heads:
            yield h.pred
