"""Graph queries: a SPARQL subset as an algebra over triple patterns.

SELECT and ASK over basic graph patterns, with FILTER, OPTIONAL, UNION, MINUS,
BIND, SERVICE, DISTINCT, ORDER BY, LIMIT and OFFSET.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.builtins import BUILTINS
from ..plans.model import Const, Term, Var
from ..sources.notation3 import unescaped
from ..terms import RDF, RDFS, OWL, TYPE, XSD, iri, literal

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<string>\"(?:[^"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<var>[?$][A-Za-z_]\w*)
    |(?P<bnode>_:\w+)
    |(?P<op>&&|\|\||!=|<=|>=|\^\^|[{}()\[\].;,=<>!*+/|-])
    |(?P<name>(?:[A-Za-z_][\w-]*)?:[\w-]*|[A-Za-z]\w*)""",
    re.X | re.S,
)


class QueryProblem(ValueError):
    """A query outside the supported language."""


@dataclass
class Group:
    """Elements in order: ``triple``, ``filter``, ``optional``, ``union``, ``minus``, ``bind``, ``service``, ``group``."""

    parts: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Query:
    kind: str
    variables: list[str] | None
    where: Group
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    @property
    def patterns(self) -> list[tuple[Term, Term, Term]]:
        """The triple patterns of a query that is one basic graph pattern."""
        if any(k not in ("triple", "filter") for k, _ in self.where.parts):
            raise QueryProblem("more than a basic graph pattern")
        return [x for k, x in self.where.parts if k == "triple"]


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str]) -> None:
        self.prefixes = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, **prefixes}
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryProblem(f"at {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.blank = 0, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def word(self) -> str:
        kind, text = self.peek()
        return text.upper() if kind == "name" else text

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if value is not None and (text.upper() if kind == "name" else text) != value:
            raise QueryProblem(f"{value} expected, found {text or 'the end'}")
        self.at += 1
        return kind, text

    def query(self) -> Query:
        while self.word() in ("PREFIX", "BASE"):
            word = self.take()[1].upper()
            if word == "PREFIX":
                name = self.take()[1].rstrip(":")
                self.prefixes[name] = self.take()[1][1:-1]
            else:
                self.take()
        kind = self.take()[1].upper()
        if kind not in ("SELECT", "ASK"):
            raise QueryProblem(f"{kind} queries are not supported")
        names: list[str] | None = []
        distinct = False
        if kind == "SELECT":
            if self.word() in ("DISTINCT", "REDUCED"):
                self.take()
                distinct = True
            if self.word() == "*":
                self.take()
                names = None
            else:
                while self.peek()[0] == "var":
                    names.append(self.take()[1][1:])
                if not names:
                    raise QueryProblem("no variables")
        if self.word() == "WHERE":
            self.take()
        out = Query(kind, names, self.group(), distinct)
        while self.peek()[0] != "end":
            word = self.take()[1].upper()
            if word == "ORDER":
                self.take("BY")
                while self.peek()[0] == "var" or self.word() in ("ASC", "DESC"):
                    down = False
                    if self.peek()[0] != "var":
                        down = self.take()[1].upper() == "DESC"
                        self.take("(")
                        out.order.append((self.take()[1][1:], down))
                        self.take(")")
                    else:
                        out.order.append((self.take()[1][1:], down))
            elif word == "LIMIT":
                out.limit = int(self.take()[1])
            elif word == "OFFSET":
                out.offset = int(self.take()[1])
            else:
                raise QueryProblem(f"unexpected {word}")
        return out

    def group(self) -> Group:
        self.take("{")
        out = Group()
        while self.word() != "}":
            word = self.word()
            if word == "FILTER":
                self.take()
                out.parts.append(("filter", self.expression()))
            elif word in ("OPTIONAL", "MINUS"):
                self.take()
                out.parts.append((word.lower(), self.group()))
            elif word == "SERVICE":
                self.take()
                out.parts.append(("service", (str(self.term().value), self.group())))
            elif word == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.parts.append(("bind", (self.take()[1][1:], e)))
                self.take(")")
            elif word == "{":
                choices = [self.group()]
                while self.word() == "UNION":
                    self.take()
                    choices.append(self.group())
                out.parts.append(("union", choices) if len(choices) > 1 else ("group", choices[0]))
            else:
                self.triples(out)
            if self.word() == ".":
                self.take()
        self.take("}")
        return out

    def triples(self, out: Group) -> None:
        s = self.term(out)
        if self.word() in (".", "}"):
            return
        self.properties(s, out)

    def properties(self, s: Term, out: Group) -> None:
        while True:
            p = self.term(out)
            while True:
                out.parts.append(("triple", (s, p, self.term(out))))
                if self.word() != ",":
                    break
                self.take()
            if self.word() != ";":
                return
            while self.word() == ";":
                self.take()
            if self.word() in (".", "}", "]"):
                return

    def term(self, out: Group | None = None) -> Term:
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Const(text)
        if kind == "bnode":
            return Var("_" + text[2:])
        if kind == "number":
            return Const(literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")))
        if kind == "string":
            body = unescaped(text[1:-1])
            if self.peek()[0] == "lang":
                return Const(literal(body, lang=self.take()[1][1:]))
            if self.word() == "^^":
                self.take()
                return Const(literal(body, str(self.term().value)[1:-1]))
            return Const(literal(body))
        if kind == "name":
            if text == "a":
                return Const(TYPE)
            if text in ("true", "false"):
                return Const(literal(text, XSD + "boolean"))
            prefix, colon, local = text.partition(":")
            if colon and prefix in self.prefixes:
                return Const(iri(self.prefixes[prefix] + local))
            raise QueryProblem(f"no such prefix: {text}")
        if text == "[" and out is not None:
            self.blank += 1
            node = Var(f"_anon{self.blank}")
            if self.word() != "]":
                self.properties(node, out)
            self.take("]")
            return node
        raise QueryProblem(f"unexpected {text!r}")

    # expressions are nested tuples: ("var", name), ("term", value), (operator, arguments...)
    def expression(self, level: int = 0):
        levels = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))
        if level == len(levels):
            return self.unary()
        left = self.expression(level + 1)
        while self.word() in levels[level]:
            op = self.take()[1]
            left = (op, left, self.expression(level + 1))
        return left

    def unary(self):
        kind, text = self.peek()
        if text == "!":
            self.take()
            return ("!", self.unary())
        if text == "(":
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if kind == "name" and self.peek(1)[1] == "(":
            name = self.take()[1]
            self.take("(")
            args = []
            while self.word() != ")":
                args.append(self.expression())
                if self.word() == ",":
                    self.take()
            self.take(")")
            return (name if ":" in name and f"{name}" in BUILTINS else name.lower(), *args)
        t = self.term()
        return ("var", t.name) if isinstance(t, Var) else ("term", t.value)


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return _Parser(text, prefixes or {}).query()
