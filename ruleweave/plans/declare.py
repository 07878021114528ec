"""Declarations of which predicates are derived, in a small vocabulary.

Lists typed DerivedClassList, DerivedPropertyList and BaseClassList enumerate
predicates; lists typed DerivedPropertyPrefix, BasePropertyPrefix,
DerivedClassPrefix and BaseClassPrefix hold namespace prefixes; nodes typed
DerivedClassQuery have a query (rdf:value) over the ontology whose answers are
predicates. The terms are known by their local names, in any namespace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from ..ontology.graph import Graph, Triple
from ..terms import OWL, RDF, TYPE, iri, local_name, parsed
from .model import Rule, Var

#: Answers a query text over ontology triples with predicates.
Answer = Callable[[str], Iterable[str]]


def declared_predicates(declarations: Iterable[Triple], ontology: Iterable[Triple], rules: Iterable[Rule], answer: Answer | None = None) -> set[str]:
    """The derived predicates: those declared so, by list, prefix or query, and not declared base."""
    d, o = Graph(declarations), Graph(ontology)
    lists: dict[str, list[str]] = {}
    for s, _, kind in sorted(d.match(None, TYPE)):
        lists.setdefault(local_name(kind), []).extend(d.items(s))
    heads = {h.pred for r in rules for h in r.heads if not isinstance(h.pred, Var)}
    kinds = {k: {s for x in names for s in o.subjects(TYPE, iri(OWL + x))} for k, names in {"Property": ("ObjectProperty", "DatatypeProperty"), "Class": ("Class",)}.items()}

    def under(prefixes: list[str], names: Iterable[str]) -> set[str]:
        at = tuple(parsed(p)[1] for p in prefixes)
        return {n for n in names if at and parsed(n)[1].startswith(at)}

    derived = set(lists.get("DerivedClassList", [])) | set(lists.get("DerivedPropertyList", []))
    base = set(lists.get("BaseClassList", []))
    for kind, found in kinds.items():
        derived |= under(lists.get(f"Derived{kind}Prefix", []), found | heads)
        base |= under(lists.get(f"Base{kind}Prefix", []), found | heads)
    if answer is not None:
        for s, _, kind in d.match(None, TYPE):
            if local_name(kind) == "DerivedClassQuery":
                for q in d.objects(s, iri(RDF + "value")):
                    derived |= set(answer(parsed(q)[1]))
    return derived - base
