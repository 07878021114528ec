"""Evaluation of parsed graph queries over relations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import BUILTINS
from ..plans.compiler import join_order, scan
from ..plans.model import Atom, Const, Var, triple_atom
from ..plans.query import Group, Query, QueryProblem
from ..terms import lexical, numeric
from .fixpoint import Relations

_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
}
_FUNCTIONS = {
    "str": lambda x: lexical(x), "strlen": lambda x: F.length(lexical(x)), "lcase": lambda x: F.lower(lexical(x)), "ucase": lambda x: F.upper(lexical(x)),
    "isiri": lambda x: x.cast("string").startswith("<"), "isuri": lambda x: x.cast("string").startswith("<"), "isblank": lambda x: x.cast("string").startswith("_:"),
    "isliteral": lambda x: ~x.cast("string").rlike("^(<|_:)"), "bound": lambda x: x.isNotNull(), "lang": lambda x: F.regexp_extract(x.cast("string"), r'"@([A-Za-z0-9-]+)$', 1),
    "contains": lambda a, b: lexical(a).contains(lexical(b)), "strstarts": lambda a, b: lexical(a).startswith(lexical(b)), "strends": lambda a, b: lexical(a).endswith(lexical(b)),
    "regex": lambda a, b: F.regexp_like(lexical(a), lexical(b)),
}


def _is_number(e: tuple) -> bool:
    return e[0] in ("+", "-", "*", "/", "strlen") or e[0] == "term" and ("XMLSchema#integer>" in str(e[1]) or "XMLSchema#decimal>" in str(e[1]) or "XMLSchema#double>" in str(e[1]))


def column(e: tuple) -> Column:
    """An expression as a column; comparisons go by value if a side is a number, else by term, order by lexical form."""
    op, args = e[0], e[1:]
    if op == "var":
        return F.col(args[0])
    if op == "term":
        return F.lit(args[0])
    if op == "!":
        return ~column(args[0])
    if op == "&&":
        return column(args[0]) & column(args[1])
    if op == "||":
        return column(args[0]) | column(args[1])
    if op in _COMPARE:
        a, b = column(args[0]), column(args[1])
        if op in "+-*/" or _is_number(args[0]) or _is_number(args[1]):
            return _COMPARE[op](numeric(a), numeric(b))
        if op in ("=", "!="):
            return _COMPARE[op](a.cast("string"), b.cast("string"))
        both = numeric(a).isNotNull() & numeric(b).isNotNull()
        return F.when(both, _COMPARE[op](numeric(a), numeric(b))).otherwise(_COMPARE[op](lexical(a), lexical(b)))
    if op in _FUNCTIONS:
        return _FUNCTIONS[op](*map(column, args))
    if op in BUILTINS:
        return BUILTINS[op](*map(column, args))
    raise QueryProblem(f"no such function: {op}")


#: Variables that are fixed beforehand, and their terms. They stay columns, so that groups still join by them.
Bindings = Mapping[str, object]


def pattern_atom(triple: tuple, bound: Bindings) -> Atom:
    """The atom of a triple pattern; a fixed variable in the place of the predicate names it."""
    s, p, o = triple
    return triple_atom(s, Const(bound[p.name]) if isinstance(p, Var) and p.name in bound else p, o)


def _scan_fixed(atom: Atom, relations: Relations, fixed: Bindings) -> DataFrame:
    out = scan(atom, relations.read(atom))
    for v in atom.vars:
        if v in fixed:
            out = out.where(F.col(v) == F.lit(fixed[v]))
    return out


def join_patterns(atoms: list[Atom], relations: Relations, fixed: Bindings | None = None) -> DataFrame:
    """The natural join of triple patterns."""
    out: DataFrame | None = None
    bound: set[str] = set()
    for i in join_order(atoms):
        new = _scan_fixed(atoms[i], relations, fixed or {})
        shared = sorted(bound & set(atoms[i].vars))
        out = new if out is None else out.join(new, shared) if shared else out.crossJoin(new)
        if "_true" in out.columns and len(out.columns) > 1:
            out = out.drop("_true")
        bound |= set(atoms[i].vars)
    assert out is not None
    return out


def _compatible(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns and c != "_true"]
    if shared:
        return left.join(right, shared, how)
    if how == "inner":
        return left.crossJoin(right.drop("_true"))
    return left.join(right.drop("_true"), F.lit(True), how) if how == "left" else left


def variables_of(e: object) -> set[str]:
    """The variables of an expression."""
    if not isinstance(e, tuple):
        return set()
    return {e[1]} if e[0] == "var" else set().union(*map(variables_of, e[1:]))


def _with_fixed(out: DataFrame, names: set[str], fixed: Bindings) -> DataFrame:
    for n in sorted(names):
        if n in fixed and n not in out.columns:
            out = out.withColumn(n, F.lit(fixed[n]))
    return out


def solve(group: Group, relations: Relations, fixed: Bindings | None = None) -> DataFrame:
    """The solutions of a group: patterns joined, then the other parts in order, filters last. ``fixed`` holds in every group within."""
    out: DataFrame | None = None
    fixed = fixed or {}
    atoms = [pattern_atom(x, fixed) for k, x in group.parts if k == "triple"]
    if atoms:
        out = join_patterns(atoms, relations, fixed)
        out = _with_fixed(out, {x[1].name for k, x in group.parts if k == "triple" and isinstance(x[1], Var)}, fixed)
    filters = []
    for kind, x in group.parts:
        if kind == "filter":
            filters.append(x)
        elif kind in ("group", "union"):
            choices = [solve(g, relations, fixed) for g in (x if kind == "union" else [x])]
            new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), choices)
            out = new if out is None else _compatible(out, new, "inner")
        elif kind in ("optional", "minus"):
            new = solve(x, relations, fixed)
            if out is None:
                out = relations.spark.range(1).select(F.lit(True).alias("_true"))
            if kind == "minus":
                shared = [c for c in out.columns if c in new.columns and c != "_true"]
                out = out.join(new.select(*shared).distinct(), shared, "left_anti") if shared else out
            else:
                out = _compatible(out, new, "left")
        elif kind == "service":
            new = _served(*x, relations, fixed)
            out = new if out is None else _compatible(out, new, "inner")
        elif kind == "bind":
            if out is None:
                out = relations.spark.range(1).select(F.lit(True).alias("_true"))
            out = _with_fixed(out, variables_of(x[1]), fixed)
            out = out.where(column(x[1]).cast("string") == F.lit(str(fixed[x[0]]))).withColumn(x[0], F.lit(fixed[x[0]])) if x[0] in fixed else out.withColumn(x[0], column(x[1]))
    if out is None:
        raise QueryProblem("an empty pattern")
    for f in filters:
        out = _with_fixed(out, variables_of(f), fixed).where(column(f))
    return out


def _served(name: str, group: Group, relations: Relations, fixed: Bindings) -> DataFrame:
    """The solutions of a basic graph pattern at an endpoint, asked for in one query."""
    from ..sources.endpoint import to_sparql

    if name not in relations.services:
        raise QueryProblem(f"no endpoint is known for {name}")
    if any(k != "triple" for k, _ in group.parts):
        raise QueryProblem("a service answers triple patterns only")
    atoms = atoms_of(group, fixed)
    names = sorted({v for a in atoms for v in a.vars})
    found = relations.services[name].query(to_sparql(atoms, names))
    if isinstance(found, bool):
        return relations.spark.range(1).where(F.lit(found)).select(F.lit(True).alias("_true"))
    return found.select(*names)


def answer(query: Query, relations: Relations, fixed: Bindings | None = None) -> DataFrame:
    """SELECT: one column a variable that is not fixed, distinct solutions. ASK: one row with a boolean ``answer``."""
    found = solve(query.where, relations, fixed).drop(*(fixed or {}))
    if query.kind == "ASK":
        return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    names = query.variables if query.variables is not None else [c for c in found.columns if not c.startswith("_")]
    missing = [n for n in names if n not in found.columns]
    out = found.select(*[F.col(n) if n not in missing else F.lit(None).cast("string").alias(n) for n in names]).distinct()
    if query.order:
        # numbers by value, all else by its term
        keys = [(k, down) for n, down in query.order for k in (numeric(F.col(n)), F.col(n))]
        out = out.orderBy(*[k.desc() if down else k.asc() for k, down in keys])
    if query.offset:
        out = out.offset(query.offset)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out


def atoms_of(group: Group, fixed: Bindings | None = None) -> list[Atom]:
    """The atoms of all groups within, fixed variables as constants."""
    fixed, out = fixed or {}, []
    for kind, x in group.parts:
        if kind == "triple":
            out.append(triple_atom(*[Const(fixed[t.name]) if isinstance(t, Var) and t.name in fixed else t for t in x]))
        elif kind == "union":
            out += [a for g in x for a in atoms_of(g, fixed)]
        elif kind in ("group", "optional", "minus"):
            out += atoms_of(x, fixed)
    return out


def has_var_pred(atoms: list[Atom]) -> bool:
    return any(isinstance(a.pred, Var) for a in atoms)
