"""Rules of equality: equal nodes have the facts of each other."""

from __future__ import annotations

from ..plans.model import Atom, Rule, Var
from ..terms import OWL, iri

SAME_AS, DIFFERENT = iri(OWL + "sameAs"), iri(OWL + "differentFrom")


def equal_facts(pred: str, places: list[bool]) -> list[Rule]:
    """The rules that give equal nodes the facts of ``pred`` (one argument or two), in those places that hold nodes."""
    args = tuple(Var(f"A{i}") for i in range(len(places)))
    out = []
    for i, held in enumerate(places):
        if held:
            other = tuple(Var("Z") if k == i else a for k, a in enumerate(args))
            out.append(Rule((Atom(pred, other),), (Atom(SAME_AS, (args[i], Var("Z"))), Atom(pred, args))))
    return out


def node_kinds(rules: list[Rule], kinds: dict[str, list[str]]) -> set[str]:
    """The column types of equal nodes: those of the places from which rules derive equality."""
    out: set[str] = set()
    for r in rules:
        for h in r.heads:
            if h.pred == SAME_AS:
                out |= {kinds[a.pred][i] for a in r.positive if a.pred != SAME_AS and a.pred in kinds for i, t in enumerate(a.args) if t in h.args}
    return out
