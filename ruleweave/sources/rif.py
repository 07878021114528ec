"""Rules in RIF-Core XML (presentation tags of the public schema)."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..plans.model import And, Builtin, Condition, Const, Exists, Or, Rule, Term, Var, triple_atom
from ..plans.normal import rules_of
from ..terms import SAME_AS, TYPE, XSD, iri, literal

_NS = "{http://www.w3.org/2007/rif#}"
_IRI_TYPE = "http://www.w3.org/2007/rif#iri"
_LOCAL_TYPE = "http://www.w3.org/2007/rif#local"


class RifProblem(ValueError):
    """A document outside RIF-Core."""


def _tag(e: ET.Element) -> str:
    return e.tag.removeprefix(_NS)


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return e.find(_NS + name)


def _only(e: ET.Element) -> ET.Element:
    inner = [x for x in e if _tag(x) not in ("id", "meta")]
    if len(inner) != 1:
        raise RifProblem(f"one element expected in {_tag(e)}")
    return inner[0]


def _term(e: ET.Element) -> Term:
    if _tag(e) == "Var":
        return Var((e.text or "").strip())
    if _tag(e) != "Const":
        raise RifProblem(f"not a term: {_tag(e)}")
    text, kind = (e.text or "").strip(), e.get("type", XSD + "string")
    if kind == _IRI_TYPE:
        return Const(iri(text))
    if kind == _LOCAL_TYPE:
        return Const("_:" + text)
    return Const(literal(text, kind))


def _args(e: ET.Element) -> list[Term]:
    held = _child(e, "args")
    return [_term(x) for x in held] if held is not None else []


def _condition(e: ET.Element) -> Condition:
    tag = _tag(e)
    if tag in ("And", "Or"):
        parts = tuple(_condition(_only(f)) for f in e.findall(_NS + "formula"))
        return And(parts) if tag == "And" else Or(parts)
    if tag == "Exists":
        names = tuple((_only(d).text or "").strip() for d in e.findall(_NS + "declare"))
        return Exists(names, _condition(_only(_child(e, "formula"))))
    if tag == "Atom":
        op, args = _term(_only(_child(e, "op"))), _args(e)
        if len(args) > 2:
            raise RifProblem("atoms have at most two arguments")
        if len(args) == 1:
            return triple_atom(args[0], Const(TYPE), op)
        return triple_atom(args[0], op, args[1])
    if tag == "Frame":
        s = _term(_only(_child(e, "object")))
        parts = []
        for slot in e.findall(_NS + "slot"):
            p, o = list(slot)
            parts.append(triple_atom(s, _term(p), _term(o)))
        return parts[0] if len(parts) == 1 else And(tuple(parts))
    if tag in ("Member", "Subclass"):
        names = ("instance", "class") if tag == "Member" else ("sub", "super")
        s, o = (_term(_only(_child(e, n))) for n in names)
        p = TYPE if tag == "Member" else iri("http://www.w3.org/2000/01/rdf-schema#subClassOf")
        return triple_atom(s, Const(p), o)
    if tag == "Equal":
        return triple_atom(_term(_only(_child(e, "left"))), Const(SAME_AS), _term(_only(_child(e, "right"))))
    if tag == "External":
        inner = _only(_child(e, "content"))
        op = _term(_only(_child(inner, "op")))
        return Builtin(str(op), tuple(_args(inner)))
    raise RifProblem(f"{tag} is not in RIF-Core")


def _sentence(e: ET.Element) -> list[Rule]:
    tag = _tag(e)
    if tag == "Forall":
        return _sentence(_only(_child(e, "formula")))
    if tag == "Implies":
        body, head = _condition(_only(_child(e, "if"))), _condition(_only(_child(e, "then")))
        return rules_of(head, body)
    if tag == "Group":
        return [r for s in e.findall(_NS + "sentence") for r in _sentence(_only(s))]
    return rules_of(_condition(e), None)


def parse_rif(text: str) -> list[Rule]:
    """The rules (and facts, as rules without a body) of a RIF-Core document."""
    root = ET.fromstring(text)
    if _tag(root) != "Document":
        raise RifProblem("not a RIF document")
    out: list[Rule] = []
    for payload in root.findall(_NS + "payload"):
        out += _sentence(_only(payload))
    return out
