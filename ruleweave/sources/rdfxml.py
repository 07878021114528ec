"""RDF/XML files, parsed on the driver into triples."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from ..terms import RDF, TYPE, iri, literal

_R = "{" + RDF + "}"
_LANG, _BASE = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
_NOT_PROPERTIES = {_R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")} | {_LANG, _BASE}


class _Reader:
    def __init__(self, base: str) -> None:
        self.base, self.out, self.blank = base, [], 0

    def fresh(self) -> str:
        self.blank += 1
        return f"_:x{self.blank}"

    @staticmethod
    def name(tag: str) -> str:
        return iri(tag[1:].replace("}", "", 1)) if tag.startswith("{") else iri(tag)

    def resolved(self, ref: str) -> str:
        return iri(self.base.split("#")[0] + ref if ref.startswith("#") or not ref else urljoin(self.base, ref))

    def subject(self, e: ET.Element) -> str:
        if (x := e.get(_R + "about")) is not None:
            return self.resolved(x)
        if (x := e.get(_R + "ID")) is not None:
            return self.resolved("#" + x)
        if (x := e.get(_R + "nodeID")) is not None:
            return "_:" + x
        return self.fresh()

    def node(self, e: ET.Element, lang: str | None) -> str:
        s, lang = self.subject(e), e.get(_LANG, lang)
        if e.tag != _R + "Description":
            self.out.append((s, TYPE, self.name(e.tag)))
        for k, v in e.attrib.items():
            if k not in _NOT_PROPERTIES:
                self.out.append((s, self.name(k), iri(v) if k == _R + "type" else literal(v, lang=lang)))
        count = 0
        for p in e:
            if p.tag == _R + "li":
                count += 1
                p.tag = f"{_R}_{count}"
            self.prop(s, p, lang)
        return s

    def prop(self, s: str, p: ET.Element, lang: str | None) -> None:
        name, lang, kind = self.name(p.tag), p.get(_LANG, lang), p.get(_R + "parseType")
        inner = list(p)
        if (x := p.get(_R + "resource")) is not None:
            o = self.resolved(x)
        elif (x := p.get(_R + "nodeID")) is not None:
            o = "_:" + x
        elif kind == "Collection":
            o = iri(RDF + "nil")
            for item in reversed([self.node(c, lang) for c in inner]):
                cell = self.fresh()
                self.out += [(cell, iri(RDF + "first"), item), (cell, iri(RDF + "rest"), o)]
                o = cell
        elif kind == "Resource":
            o = self.fresh()
            for c in inner:
                self.prop(o, c, lang)
        elif inner:
            o = self.node(inner[0], lang)
        elif kind == "Literal":
            o = literal(p.text or "", RDF + "XMLLiteral")
        elif extra := [k for k in p.attrib if k not in _NOT_PROPERTIES]:
            o = self.fresh()
            for k in extra:
                self.out.append((o, self.name(k), literal(p.attrib[k], lang=lang)))
        else:
            dt = p.get(_R + "datatype")
            o = literal(p.text or "", dt) if dt else literal(p.text or "", lang=lang)
        self.out.append((s, name, o))


def parse_rdfxml(text: str, base: str = "http://example.org/doc") -> list[tuple[str, str, str]]:
    root = ET.fromstring(text)
    reader = _Reader(root.get(_BASE, base))
    for e in root if root.tag == _R + "RDF" else [root]:
        reader.node(e, root.get(_LANG))
    return reader.out
