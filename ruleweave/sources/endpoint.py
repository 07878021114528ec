"""A remote SPARQL endpoint as a source of stored facts.

The request itself is a function (text in, response text out), so that tests and
sites with their own clients can supply it. Failures raise; they are never an
empty result.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.model import Atom, Const, Var
from ..storage import saved
from ..terms import TYPE, iri, literal

Transport = Callable[[str], str]


class EndpointProblem(RuntimeError):
    """The endpoint could not be reached, or its answer not be read."""


def http_transport(url: str, timeout: float = 120) -> Transport:
    def send(query: str) -> str:
        body = urllib.parse.urlencode({"query": query}).encode()
        request = urllib.request.Request(url, body, {"Accept": "application/sparql-results+json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode()
        except OSError as problem:
            raise EndpointProblem(f"{url}: {problem}") from problem

    return send


def term_of(x: dict) -> str:
    """A term of the JSON results format."""
    if x["type"] == "uri":
        return iri(x["value"])
    if x["type"] == "bnode":
        return "_:" + x["value"]
    return literal(x["value"], x.get("datatype"), x.get("xml:lang"))


def results(text: str) -> tuple[list[str], list[tuple[str | None, ...]]] | bool:
    """Variables and rows of a SELECT, or the truth of an ASK."""
    try:
        data = json.loads(text)
        if "boolean" in data:
            return bool(data["boolean"])
        names = data["head"]["vars"]
        return names, [tuple(term_of(b[n]) if n in b else None for n in names) for b in data["results"]["bindings"]]
    except (ValueError, KeyError, TypeError) as problem:
        raise EndpointProblem(f"not a result: {problem}") from problem


def to_sparql(atoms: list[Atom], variables: list[str], service: str | None = None) -> str:
    """A conjunction of atoms as one query; ASK if no variable is wanted."""

    def text(t) -> str:
        return f"?{t.name}" if isinstance(t, Var) else str(t.value)

    lines = []
    for a in atoms:
        p = text(a.pred) if isinstance(a.pred, Var) else a.pred
        lines.append(f"{text(a.args[0])} {TYPE} {p} ." if len(a.args) == 1 else f"{text(a.args[0])} {p} {text(a.args[1])} .")
    where = "\n  ".join(lines)
    if service:
        where = f"SERVICE <{service}> {{ {where} }}"
    return (f"SELECT DISTINCT {' '.join('?' + v for v in variables)}" if variables else "ASK") + f" {{\n  {where}\n}}"


#: Pages that the driver holds before it writes them.
HELD_PAGES = 20


class Endpoint:
    def __init__(self, spark: SparkSession, transport: Transport, page: int = 10_000) -> None:
        self.spark, self.transport, self.page = spark, transport, page

    def query(self, text: str) -> DataFrame | bool:
        found = results(self.transport(text))
        if isinstance(found, bool):
            return found
        names, rows = found
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    def facts(self, pred: str, arity: int = 2) -> DataFrame:
        """All facts of a predicate, page by page; the driver holds some pages at a time and writes them to the shared folder."""
        s, o = Var("s"), Var("o")
        a = Atom(pred, (s, o) if arity == 2 else (s,))
        names = ["s", "o"][:arity]
        base = to_sparql([a], names) + " ORDER BY " + " ".join("?" + n for n in names)
        schema = ", ".join(f"{n} string" for n in names)
        rows: list[tuple] = []
        out, seen = None, 0
        while True:
            found = results(self.transport(f"{base} LIMIT {self.page} OFFSET {seen}"))
            if isinstance(found, bool):
                raise EndpointProblem("a truth value for a SELECT")
            rows += found[1]
            seen += len(found[1])
            last = len(found[1]) < self.page
            if last or len(rows) >= HELD_PAGES * self.page:
                part = self.spark.createDataFrame(rows, schema)
                part = part if last and out is None else saved(part, "endpoint")
                out, rows = part if out is None else out.unionByName(part), []
            if last:
                return out

    def holds(self, pred: str, *args: str) -> bool:
        return self.transport and results(self.transport(to_sparql([Atom(pred, tuple(map(Const, args)))], []))) is True
