"""RDF terms as canonical strings, the values that joins compare.

``<iri>``, ``_:label`` and quoted literals with their datatype or language, as in
N-Triples. Terms are equal if their strings are: kind, lexical form, datatype and
language. Numbers are compared by value only in ``math:`` builtins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces (fixed values).
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
LOG = "http://www.w3.org/2000/10/swap/log#"
MATH = "http://www.w3.org/2000/10/swap/math#"
STRING = "http://www.w3.org/2000/10/swap/string#"
TYPE = f"<{RDF}type>"
IMPLIES = f"<{LOG}implies>"
SAME_AS = f"<{OWL}sameAs>"

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_LITERAL = re.compile(r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$', re.S)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(value: object, datatype: str | None = None, lang: str | None = None) -> str:
    """The canonical string of a literal; Python numbers and booleans get their XSD types."""
    if datatype is None and lang is None and not isinstance(value, str):
        kinds = {bool: "boolean", int: "integer", float: "double"}
        datatype = XSD + kinds[type(value)]
        value = str(value).lower() if isinstance(value, bool) else repr(value)
    text = "".join(_ESCAPES.get(c, c) for c in str(value))
    if lang:
        return f'"{text}"@{lang.lower()}'
    if datatype and datatype != XSD + "string":
        return f'"{text}"^^<{datatype}>'
    return f'"{text}"'


def parsed(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form, datatype, language) with kind iri, bnode or literal."""
    if term.startswith("<"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "bnode", term[2:], None, None
    m = _LITERAL.match(term)
    if not m:
        return "literal", term, None, None
    back = {"\\\\": "\\", '\\"': '"', "\\n": "\n", "\\r": "\r", "\\t": "\t"}
    return "literal", re.sub(r"\\.", lambda x: back.get(x.group(), x.group()), m[1], flags=re.S), m[2], m[3]


def local_name(term: str) -> str:
    return re.split(r"[#/:]", term.strip("<>"))[-1] if term.startswith("<") else term


def lexical(term: Column) -> Column:
    """The lexical form of a canonical term, or the value itself where it is no canonical term."""
    text = term.cast("string")
    body = F.regexp_extract(text, r'(?s)^"((?:[^"\\]|\\.)*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    plain = F.regexp_replace(F.regexp_replace(body, r'\\"', '"'), r"\\\\", r"\\\\")
    inner = F.regexp_extract(text, r"(?s)^<(.*)>$", 1)
    return F.when(text.startswith('"'), plain).when(text.startswith("<"), inner).otherwise(text)


def numeric(term: Column) -> Column:
    """The value of a number, null for other terms."""
    return lexical(term).try_cast("double")
