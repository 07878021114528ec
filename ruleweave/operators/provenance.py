"""Why a fact holds: the firings of all rules over a closure, and proofs from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiler, value
from ..plans.model import Atom, Rule, Var
from ..terms import TYPE
from .fixpoint import Relations

FIRINGS = "rule string, s string, p string, o string, bindings map<string,string>, antecedents array<struct<s:string,p:string,o:string>>"


def _triple(a: Atom) -> tuple[Column, Column, Column]:
    text = lambda t: value(t).cast("string")
    if len(a.args) == 1:
        return text(a.args[0]), F.lit(TYPE), F.lit(a.pred)
    p = F.col(a.pred.name) if isinstance(a.pred, Var) else F.lit(a.pred)
    return text(a.args[0]), p, text(a.args[1])


def firings(rules: list[Rule], relations: Relations, compiler: Compiler) -> DataFrame:
    """One row for each match of each rule's body over the closure and each of its heads.

    Columns: rule, the fact (s, p, o), the bindings of the body's variables, and
    the positive body atoms' facts as antecedents.
    """
    out: DataFrame | None = None
    for r in rules:
        if not r.positive and not r.negative:
            continue
        m = compiler.with_invented(r, compiler.body(r, relations.read))
        names = [n for n in r.body_vars if n in m.columns]
        pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
        bindings = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
        ante = [F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in map(_triple, r.positive)]
        antecedents = F.array(*ante) if ante else F.expr("cast(array() as array<struct<s:string,p:string,o:string>>)")
        for h in r.heads:
            s, p, o = _triple(h)
            rows = m.select(F.lit(r.name).alias("rule"), s.alias("s"), p.alias("p"), o.alias("o"), bindings.alias("bindings"), antecedents.alias("antecedents"))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else relations.spark.createDataFrame([], FIRINGS)


def firing_counts(found: DataFrame) -> DataFrame:
    """(rule, n), the most active rule first."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


@dataclass
class Proof:
    """A conclusion with one justification: the rule and proofs of its antecedents; none for a stored fact."""

    fact: tuple[str, str, str]
    rule: str | None = None
    bindings: dict[str, str] = field(default_factory=dict)
    antecedents: list[Proof] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.antecedents), default=0)

    def lines(self, level: int = 0) -> list[str]:
        s, p, o = self.fact
        why = f"  [{self.rule}]" if self.rule else "  [stored]"
        return ["  " * level + f"{s} {p} {o}{why}"] + [x for a in self.antecedents for x in a.lines(level + 1)]

    def dot(self) -> str:
        """The proof as Graphviz text."""
        out, todo, n = ["digraph proof {"], [(self, 0)], 0
        while todo:
            node, i = todo.pop()
            label = " ".join(node.fact).replace('"', "'")
            out.append(f'  n{i} [label="{label}"];')
            for a in node.antecedents:
                n += 1
                out.append(f'  n{i} -> n{n} [label="{node.rule}"];')
                todo.append((a, n))
        return "\n".join([*out, "}"])

    def pml(self) -> list[tuple[str, str, str]]:
        """The proof as triples of nodes and inference steps."""
        ns, out, todo, n = "http://inferenceweb.stanford.edu/2004/07/iw.owl#", [], [(self, 0)], 0
        while todo:
            node, i = todo.pop()
            me, step = f"_:set{i}", f"_:step{i}"
            text = " ".join(node.fact).replace("\\", "\\\\").replace('"', '\\"')
            out += [(me, TYPE, f"<{ns}NodeSet>"), (me, f"<{ns}hasConclusion>", f'"{text}"'), (me, f"<{ns}isConsequentOf>", step), (step, TYPE, f"<{ns}InferenceStep>"), (step, f"<{ns}hasRule>", f'"{node.rule or "stored"}"')]
            for a in node.antecedents:
                n += 1
                out.append((step, f"<{ns}hasAntecedent>", f"_:set{n}"))
                todo.append((a, n))
        return out


class NotDerived(LookupError):
    """A fact that is neither stored nor derived."""


def prove(goal: tuple[str, str, str], found: DataFrame, stored: DataFrame, max_depth: int = 100) -> Proof:
    """A well-founded proof of one ground fact.

    Walks back from the goal, one join a level for all open facts at once. A fact
    gets the justification that needs the fewest levels, so no proof uses itself.
    """
    spark = found.sparkSession
    need, frontier = {goal}, {goal}
    steps: dict[tuple[str, str, str], list[tuple[str, dict, list]]] = {}
    known: set[tuple[str, str, str]] = set()
    for _ in range(max_depth):
        if not frontier:
            break
        asked = F.broadcast(spark.createDataFrame(sorted(frontier), "s string, p string, o string"))  # the facts of one goal's proof
        known |= {tuple(r) for r in stored.join(asked, ["s", "p", "o"]).distinct().collect()}
        for r in found.join(asked, ["s", "p", "o"]).collect():
            steps.setdefault((r["s"], r["p"], r["o"]), []).append((r["rule"], r["bindings"], [tuple(a) for a in r["antecedents"]]))
        frontier = {a for f in frontier if f not in known for _, _, ante in steps.get(f, []) for a in ante} - need
        need |= frontier
    proofs: dict[tuple[str, str, str], Proof] = {f: Proof(f) for f in known}
    changed = True
    while changed and goal not in proofs:
        changed = False
        ready = {}
        for f, options in steps.items():
            if f not in proofs:
                for name, bindings, ante in sorted(options, key=lambda x: (x[0], x[2])):
                    if all(a in proofs for a in ante):
                        ready[f] = Proof(f, name, dict(bindings), [proofs[a] for a in ante])
                        break
        proofs |= ready
        changed = bool(ready)
    if goal not in proofs:
        raise NotDerived(f"no proof of {' '.join(goal)}")
    return proofs[goal]
