"""The semi-naive fixpoint: strata in order, rounds over new facts only, set semantics.

Relations are DataFrames by predicate (vertical partitions). The new facts of a
round are written to the shared folder, which cuts their lineage; a round joins
only those with what is known, once for each recursive atom of a rule. Rules of a
component with equal heads are evaluated in one union, de-duplicated once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import strata
from ..plans.compiler import Compiler
from ..plans.model import Atom, Const, Rule, Var
from ..storage import saved
from ..terms import TYPE

MAX_ROUNDS = 500
#: Parts of a relation after which it is written anew as one.
PARTS = 8


class NoFixpoint(RuntimeError):
    """The rounds ran out: a chain longer than expected, or rules that invent nodes without end."""


#: Takes the new firings of a rule (its bindings), returns triples (s, p, o) to add.
Hook = Callable[[DataFrame], DataFrame]


def literal_type(value: object) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


class Relations:
    """Facts by predicate, with a view over all of them for atoms whose predicate is a variable."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> None:
        self.spark = spark
        self.parts: dict[str, list[DataFrame]] = {p: [df] for p, df in (tables or {}).items()}
        #: Predicates whose facts are plain scans, which cost the same whenever they are read.
        self.plain: set[str] = set()
        #: Endpoints by name, for queries that ask them.
        self.services: dict[str, object] = {}

    def copy(self) -> Relations:
        out = Relations(self.spark)
        out.services = self.services
        out.parts = {p: list(x) for p, x in self.parts.items()}
        out.plain = set(self.plain)
        return out

    def keep(self, pred: str) -> None:
        """Write a relation once if each reading of it would be computed anew."""
        if pred in self.parts and pred not in self.plain:
            whole = self.get(pred)
            assert whole is not None
            self.parts[pred] = [saved(whole, "relation")]
            self.plain.add(pred)

    def get(self, pred: str) -> DataFrame | None:
        parts = self.parts.get(pred)
        if not parts:
            return None
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def add(self, pred: str, facts: DataFrame) -> None:
        parts = self.parts.setdefault(pred, [])
        parts.append(facts)
        if len(parts) > PARTS:
            whole = self.get(pred)
            assert whole is not None
            self.parts[pred] = [saved(whole, "relation")]

    def read(self, atom: Atom) -> DataFrame:
        """The facts that an atom may match; an unknown predicate has none."""
        if isinstance(atom.pred, Var):
            return self.triples()
        if (df := self.get(atom.pred)) is not None:
            if len(df.columns) != len(atom.args):
                raise ValueError(f"{atom.pred} has {len(df.columns)} columns, {atom} has {len(atom.args)} arguments")
            return df
        columns = ["s", "o"][: len(atom.args)]
        kinds = [literal_type(t.value) if isinstance(t, Const) else "string" for t in atom.args]
        return self.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))

    def triples(self) -> DataFrame:
        """Everything as (s, p, o) strings: a class C(x) is (x, rdf:type, C)."""
        out: DataFrame | None = None
        for p in sorted(self.parts):
            df = self.get(p)
            assert df is not None
            s = F.col("s").cast("string").alias("s")
            if len(df.columns) == 1:
                rows = df.select(s, F.lit(TYPE).alias("p"), F.lit(p).alias("o"))
            else:
                rows = df.select(s, F.lit(p).alias("p"), F.col("o").cast("string").alias("o"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "s string, p string, o string")

    def subjects(self) -> DataFrame:
        return self.triples().select("s").distinct()


def split_triples(df: DataFrame, by: str = "p") -> dict[str, DataFrame]:
    """Triples as relations by predicate; ``rdf:type`` with its classes as one-column relations.

    The predicates (and classes) in use are listed by a distinct query: they are
    a vocabulary, not data.
    """
    keys = df.select("p", F.when(F.col("p") == TYPE, F.col("o")).alias("class")).distinct().collect()
    out: dict[str, DataFrame] = {}
    for p, cls in keys:
        if cls is not None:
            out[cls] = df.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s")
        elif p != TYPE:
            out[p] = df.where(F.col("p") == p).select("s", "o")
    return out


class Fixpoint:
    def __init__(self, relations: Relations, compiler: Compiler, hooks: Mapping[str, tuple[Hook, bool]] | None = None, max_rounds: int = MAX_ROUNDS, until: Atom | None = None) -> None:
        self.relations, self.compiler, self.hooks, self.max_rounds, self.until = relations, compiler, dict(hooks or {}), max_rounds, until
        self.rounds = 0
        self.derived: dict[str, list[DataFrame]] = {}
        self.reached = False

    def run(self, rules: list[Rule], new: Mapping[str, DataFrame] | None = None) -> Relations:
        """All that the rules derive. With ``new``, facts that were just added, only their consequences are derived anew.

        That holds for monotone programs; one with negation is run from its facts.
        """
        order = strata(rules)
        if self.hooks and not any(r.negative for r in rules):
            order = [list(rules)]  # a hook may write what any rule reads
        for stratum in order:
            new = self._stratum(stratum, dict(new) if new is not None else None)
            if self.reached:
                break
        return self.relations

    def _reached(self) -> bool:
        if self.until is None:
            return False
        from ..plans.compiler import scan

        self.reached = not scan(self.until, self.relations.read(self.until)).isEmpty()
        return self.reached

    def _stratum(self, rules: list[Rule], new: dict[str, DataFrame] | None) -> dict[str, DataFrame] | None:
        written = {h.pred for r in rules for h in r.heads}
        wild = any(isinstance(p, Var) for p in written) or any(r.name in self.hooks for r in rules)
        recursive = {p for r in rules for a in r.positive if (p := a.pred) in written or isinstance(p, Var) or wild}
        if recursive:  # what each round reads again is written once
            for p in {a.pred for r in rules for a in r.positive if not isinstance(a.pred, Var)} - written:
                self.relations.keep(p)
        everything = dict(new or {})
        delta = new
        for turn in range(self.max_rounds):
            found = self._round(rules, delta, recursive if turn else None)
            self.rounds += 1
            delta = {}
            for p, parts in found.items():
                facts = parts[0]
                for x in parts[1:]:
                    facts = facts.unionByName(x)
                facts = facts.distinct()
                known = self.relations.get(p)
                if known is not None:
                    facts = facts.join(known, facts.columns, "left_anti")
                facts = saved(facts, "delta")
                if not facts.isEmpty():
                    delta[p] = facts
                elif known is None:
                    self.relations.add(p, facts)  # its columns are known from here on
            for p, facts in delta.items():
                self.relations.add(p, facts)
                self.derived.setdefault(p, []).append(facts)
                if new is not None:
                    everything[p] = everything[p].unionByName(facts) if p in everything else facts
            if not delta or not recursive or self._reached():
                return everything if new is not None else None
        raise NoFixpoint(f"no fixpoint after {self.max_rounds} rounds")

    def _round(self, rules: list[Rule], delta: dict[str, DataFrame] | None, recursive: set | None) -> dict[str, list[DataFrame]]:
        found: dict[str, list[DataFrame]] = {}

        def emit(r: Rule, matches: DataFrame) -> None:
            matches = self.compiler.with_invented(r, matches)
            hook, instead = self.hooks.get(r.name, (None, False))
            if hook is not None:
                for p, df in split_triples(hook(matches)).items():
                    found.setdefault(p, []).append(df)
            if instead:
                return
            for h in r.heads:
                facts = self.compiler.head(h, matches)
                if isinstance(h.pred, Var):
                    for p, df in split_triples(saved(facts.distinct(), "wild")).items():
                        found.setdefault(p, []).append(df)
                else:
                    found.setdefault(h.pred, []).append(facts)

        if delta is None:
            for r in rules:
                if r.positive or r.negative:
                    emit(r, self.compiler.body(r, self.relations.read))
                else:  # no body: ground heads hold
                    for h in r.heads:
                        if h.vars:
                            raise ValueError(f"{r}: a head without a body must be ground")
                        found.setdefault(h.pred, []).append(self.compiler.head(h, self.relations.spark.range(1)))
            return found
        fresh = Relations(self.relations.spark, delta)
        for r in rules:
            for i, a in enumerate(r.positive):
                if isinstance(a.pred, Var) or a.pred in delta:
                    emit(r, self.compiler.body(r, self.relations.read, i, fresh.read))
        return found
