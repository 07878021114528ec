"""A small language to build ontologies in Python: classes, properties and restrictions over a graph.

``Class`` objects combine with ``&``, ``|`` and ``~``, ``+=`` and ``-=`` add and remove
superclasses' subclasses, properties give ``some``, ``only``, ``value`` and cardinalities.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..terms import OWL, RDFS, SAME_AS, TYPE, iri, literal
from . import expr as X
from .graph import Graph

_CLASS, _ONTOLOGY = iri(OWL + "Class"), iri(OWL + "Ontology")


class Node:
    """A named (or blank) node of an ontology graph, with its annotations."""

    def __init__(self, graph: Graph, node: str | None = None, kind: str | None = None) -> None:
        self.graph, self.node = graph, node or graph.fresh()
        if kind:
            graph.add(self.node, TYPE, kind)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.node == other.node

    def __hash__(self) -> int:
        return hash(self.node)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.node})"

    def _get(self, prop: str) -> list[str]:
        return self.graph.objects(self.node, prop)

    def _set(self, prop: str, values: Iterable[str]) -> None:
        self.graph.remove(self.node, prop)
        for v in values:
            self.graph.add(self.node, prop, v)

    @property
    def types(self) -> list[str]:
        return self._get(TYPE)

    @property
    def same_as(self) -> list[str]:
        return self._get(SAME_AS)

    def add_same_as(self, other: Node) -> None:
        self.graph.add(self.node, SAME_AS, other.node)

    @property
    def labels(self) -> list[str]:
        return self._get(iri(RDFS + "label"))

    def label(self, text: str, lang: str | None = None) -> None:
        self.graph.add(self.node, iri(RDFS + "label"), literal(text, lang=lang))

    @property
    def comments(self) -> list[str]:
        return self._get(iri(RDFS + "comment"))

    def comment(self, text: str) -> None:
        self.graph.add(self.node, iri(RDFS + "comment"), literal(text))

    def see_also(self, node: str) -> None:
        self.graph.add(self.node, iri(RDFS + "seeAlso"), node)

    def rename(self, node: str) -> None:
        """Give the node another name wherever it stands."""
        for s, p, o in list(self.graph.match()):
            if self.node in (s, p, o):
                self.graph.remove(s, p, o)
                self.graph.add(*[node if x == self.node else x for x in (s, p, o)])
        self.node = node

    def delete(self) -> None:
        self.graph.remove(self.node)
        self.graph.remove(None, None, self.node)

    def replace(self, other: Node) -> None:
        """Let others refer to ``other`` in place of this node, and delete it."""
        for s, p, _ in list(self.graph.match(None, None, self.node)):
            self.graph.add(s, p, other.node)
        self.delete()


class Individual(Node):
    pass


class Ontology(Node):
    def __init__(self, graph: Graph, node: str) -> None:
        super().__init__(graph, node, _ONTOLOGY)

    @property
    def imports(self) -> list[str]:
        return self._get(iri(OWL + "imports"))

    def add_import(self, node: str) -> None:
        self.graph.add(self.node, iri(OWL + "imports"), node)

    @property
    def version(self) -> str | None:
        found = self._get(iri(OWL + "versionInfo"))
        return found[0] if found else None

    @version.setter
    def version(self, text: str) -> None:
        self._set(iri(OWL + "versionInfo"), [literal(text)])


class Class(Node):
    """A class; anonymous if it stands for an expression."""

    def __init__(self, graph: Graph, node: str | None = None, expression: X.Expr | None = None) -> None:
        if expression is not None and not isinstance(expression, X.Named):
            node = X.write(graph, expression, node)
            super().__init__(graph, node)
        else:
            super().__init__(graph, node or (expression.iri if expression is not None else None), _CLASS)

    @property
    def expression(self) -> X.Expr:
        return X.read(self.graph, self.node)

    @property
    def definition(self) -> X.Expr:
        """What the class itself is defined as by an intersection, union, complement or enumeration."""
        return X.read(self.graph, self.node, True)

    def _combined(self, kind, other: Class) -> Class:
        return Class(self.graph, None, X.flattened(kind((self.expression, other.expression))))

    def __and__(self, other: Class) -> Class:
        return self._combined(X.AllOf, other)

    def __or__(self, other: Class) -> Class:
        return self._combined(X.AnyOf, other)

    def __invert__(self) -> Class:
        return Class(self.graph, None, X.Complement(self.expression))

    def __iadd__(self, other: Class | Iterable[Class]) -> Class:
        for c in [other] if isinstance(other, Class) else other:
            self.graph.add(c.node, X.SUB_CLASS, self.node)
        return self

    def __isub__(self, other: Class) -> Class:
        self.graph.remove(other.node, X.SUB_CLASS, self.node)
        return self

    def _classes(self, prop: str) -> list[Class]:
        return [Class(self.graph, n) if n.startswith("<") else _Existing(self.graph, n) for n in self._get(prop)]

    @property
    def sub_class_of(self) -> list[Class]:
        return self._classes(X.SUB_CLASS)

    @sub_class_of.setter
    def sub_class_of(self, supers: Iterable[Class]) -> None:
        for c in supers:
            self.graph.add(self.node, X.SUB_CLASS, c.node)

    @property
    def equivalent_class(self) -> list[Class]:
        return self._classes(X.EQUIVALENT)

    @equivalent_class.setter
    def equivalent_class(self, others: Iterable[Class]) -> None:
        self._set(X.EQUIVALENT, [c.node for c in others])

    @property
    def disjoint_with(self) -> list[Class]:
        return self._classes(iri(OWL + "disjointWith"))

    @disjoint_with.setter
    def disjoint_with(self, others: Iterable[Class]) -> None:
        self._set(iri(OWL + "disjointWith"), [c.node for c in others])

    @property
    def complement_of(self) -> Class | None:
        found = self._classes(X.COMPLEMENT)
        return found[0] if found else None

    @complement_of.setter
    def complement_of(self, other: Class) -> None:
        self._set(X.COMPLEMENT, [other.node])

    @property
    def parents(self) -> list[str]:
        """Named superclasses, and named parts of intersections that the class is or is under."""
        out = []
        for e in [c.expression for c in self.sub_class_of + self.equivalent_class] + [self.definition]:
            out += [p.iri for p in (e.parts if isinstance(e, X.AllOf) else (e,)) if isinstance(p, X.Named) and p.iri != self.node]
        return list(dict.fromkeys(out))

    @property
    def sub_sumptee_ids(self) -> list[str]:
        return self.graph.subjects(X.SUB_CLASS, self.node)

    @property
    def extent(self) -> list[str]:
        return self.graph.subjects(TYPE, self.node)

    def is_primitive(self) -> bool:
        """Whether the class has no definition, only superclasses."""
        return not self._get(X.EQUIVALENT) and isinstance(self.definition, X.Named)

    def manchester(self) -> str:
        lines = [f"Class: {X.local_name(self.node)}"] if self.node.startswith("<") else []
        if not isinstance(self.definition, X.Named):
            lines.append(("    EquivalentTo: " if lines else "") + X.manchester(self.definition))
        for title, found in (("SubClassOf", self.sub_class_of), ("EquivalentTo", self.equivalent_class), ("DisjointWith", self.disjoint_with)):
            lines += [f"    {title}: {X.manchester(c.expression)}" for c in found]
        return "\n".join(lines)


class _Existing(Class):
    """An expression that is in the graph already."""

    def __init__(self, graph: Graph, node: str) -> None:
        Node.__init__(self, graph, node)


def enumerated(graph: Graph, node: str | None, members: Iterable[str]) -> Class:
    return Class(graph, node, X.OneOf(tuple(members)))


class BooleanClass(Class):
    """A named intersection or union whose operator can change."""

    def __init__(self, graph: Graph, node: str | None, parts: Iterable[Class], union: bool = False) -> None:
        kind = X.AnyOf if union else X.AllOf
        super().__init__(graph, node, kind(tuple(c.expression for c in parts)))

    def change_operator(self) -> None:
        e = self.definition
        assert isinstance(e, X.AllOf | X.AnyOf)
        self.graph.remove(self.node, X.INTERSECTION)
        self.graph.remove(self.node, X.UNION)
        X.write(self.graph, (X.AnyOf if isinstance(e, X.AllOf) else X.AllOf)(e.parts), self.node)


class Property(Node):
    def __init__(self, graph: Graph, node: str, kind: str = "ObjectProperty") -> None:
        super().__init__(graph, node, iri(OWL + kind))

    def _restriction(self, e: X.Expr) -> Class:
        return Class(self.graph, None, e)

    def some(self, c: Class) -> Class:
        return self._restriction(X.Some(self.node, c.expression))

    def only(self, c: Class) -> Class:
        return self._restriction(X.Only(self.node, c.expression))

    def value(self, node: str | Node) -> Class:
        return self._restriction(X.HasValue(self.node, node.node if isinstance(node, Node) else node))

    def min(self, n: int, c: Class | None = None) -> Class:
        return self._restriction(X.Cardinality("min", self.node, n, c.expression if c else None))

    def max(self, n: int, c: Class | None = None) -> Class:
        return self._restriction(X.Cardinality("max", self.node, n, c.expression if c else None))

    def exactly(self, n: int, c: Class | None = None) -> Class:
        return self._restriction(X.Cardinality("exactly", self.node, n, c.expression if c else None))

    def set_characteristic(self, kind: str) -> None:
        """``TransitiveProperty``, ``SymmetricProperty``, ``FunctionalProperty`` or ``InverseFunctionalProperty``."""
        self.graph.add(self.node, TYPE, iri(OWL + kind))

    def sub_property_of(self, other: Property) -> None:
        self.graph.add(self.node, iri(RDFS + "subPropertyOf"), other.node)

    def inverse_of(self, other: Property) -> None:
        self.graph.add(self.node, iri(OWL + "inverseOf"), other.node)

    def domain(self, c: Class) -> None:
        self.graph.add(self.node, iri(RDFS + "domain"), c.node)

    def range(self, c: Class) -> None:
        self.graph.add(self.node, iri(RDFS + "range"), c.node)

    @property
    def extent(self) -> list[tuple[str, str]]:
        return sorted((s, o) for s, _, o in self.graph.match(None, self.node))


class AnnotationProperty(Property):
    """A property that says something of a node and follows no rule."""

    def __init__(self, graph: Graph, node: str) -> None:
        super().__init__(graph, node, "AnnotationProperty")

    def annotate(self, node: Node, text: str, lang: str | None = None) -> None:
        self.graph.add(node.node, self.node, literal(text, lang=lang))

    def of(self, node: Node) -> list[str]:
        return node._get(self.node)


class Infix:
    """An operator between a property and a class, a node or a number: ``has |some| Person``, ``has |minimum[2]| Person``."""

    def __init__(self, name: str, prop: Property | None = None, number: int | None = None) -> None:
        self.name, self.prop, self.number = name, prop, number

    def __ror__(self, prop: Property) -> Infix:
        return Infix(self.name, prop, self.number)

    def __or__(self, other) -> Class:
        if self.prop is None:
            raise TypeError(f"{self.name} stands between a property and what it restricts")
        build = getattr(self.prop, self.name)
        if self.name not in ("min", "max", "exactly"):
            return build(other)
        return build(other) if self.number is None else build(self.number, other)

    def __getitem__(self, number: int) -> Infix:
        """With a number, a cardinality is qualified by the class that follows."""
        if self.name not in ("min", "max", "exactly"):
            raise TypeError(f"{self.name} takes no number")
        return Infix(self.name, self.prop, number)


some, only, value, minimum, maximum, exactly = map(Infix, ("some", "only", "value", "min", "max", "exactly"))


def all_classes(graph: Graph) -> list[Class]:
    return [Class(graph, n) for n in graph.subjects(TYPE, _CLASS) if n.startswith("<")]


def all_properties(graph: Graph) -> list[str]:
    kinds = ("ObjectProperty", "DatatypeProperty", "AnnotationProperty", "TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty")
    return sorted({n for k in kinds for n in graph.subjects(TYPE, iri(OWL + k))})


def component_terms(e: X.Expr) -> set[str]:
    """The named classes of an expression."""
    out: set[str] = set()
    X.mapped(e, lambda x: out.add(x.iri) or x if isinstance(x, X.Named) else x)
    return out


def deep_clear(graph: Graph, node: str) -> None:
    """Remove a class's superclasses and definition with the anonymous expressions under them."""
    for p in (X.SUB_CLASS, X.EQUIVALENT, X.INTERSECTION, X.UNION, X.COMPLEMENT, X.ONE_OF):
        for o in graph.objects(node, p):
            graph.remove(node, p, o)
            _drop(graph, o)


def _drop(graph: Graph, node: str) -> None:
    if node.startswith("_:") and not any(graph.match(None, None, node)):
        for _, p, o in list(graph.match(node)):
            graph.remove(node, p, o)
            _drop(graph, o)


class Names:
    """Classes by attribute: ``Names(graph, "http://x#").Person``."""

    def __init__(self, graph: Graph, namespace: str) -> None:
        self._graph, self._namespace = graph, namespace

    def __getattr__(self, name: str) -> Class:
        if name.startswith("_"):
            raise AttributeError(name)
        return Class(self._graph, iri(self._namespace + name))
