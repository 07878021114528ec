"""A small indexed graph on the driver, for ontologies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from ..terms import RDF, iri

FIRST, REST, NIL = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
Triple = tuple[str, str, str]


class Graph:
    """A set of triples of canonical terms, found by any of their parts."""

    def __init__(self, triples: Iterable[Triple] = ()) -> None:
        self.triples: set[Triple] = set()
        self._by: dict[tuple[int, str], set[Triple]] = {}
        self._blank = 0
        for t in triples:
            self.add(*t)

    def add(self, s: str, p: str, o: str) -> None:
        t = (s, p, o)
        if t not in self.triples:
            self.triples.add(t)
            for i, x in enumerate(t):
                self._by.setdefault((i, x), set()).add(t)

    def remove(self, s: str | None = None, p: str | None = None, o: str | None = None) -> None:
        for t in list(self.match(s, p, o)):
            self.triples.discard(t)
            for i, x in enumerate(t):
                self._by[(i, x)].discard(t)

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> Iterator[Triple]:
        sets = [self._by.get((i, x), set()) for i, x in enumerate((s, p, o)) if x is not None]
        if not sets:
            return iter(set(self.triples))
        return iter(set.intersection(*sorted(sets, key=len)))

    def objects(self, s: str, p: str) -> list[str]:
        return sorted(t[2] for t in self.match(s, p))

    def subjects(self, p: str, o: str) -> list[str]:
        return sorted(t[0] for t in self.match(None, p, o))

    def one(self, s: str, p: str) -> str | None:
        found = self.objects(s, p)
        return found[0] if found else None

    def __contains__(self, t: Triple) -> bool:
        return t in self.triples

    def __len__(self) -> int:
        return len(self.triples)

    def fresh(self) -> str:
        self._blank += 1
        return f"_:g{self._blank}"

    def items(self, head: str) -> list[str]:
        """The members of an RDF list."""
        out, seen = [], set()
        while head != NIL and head not in seen:
            seen.add(head)
            first = self.one(head, FIRST)
            if first is not None:
                out.append(first)
            head = self.one(head, REST) or NIL
        return out

    def make_list(self, items: Iterable[str]) -> str:
        rest = NIL
        for x in reversed(list(items)):
            node = self.fresh()
            self.add(node, FIRST, x)
            self.add(node, REST, rest)
            rest = node
        return rest
