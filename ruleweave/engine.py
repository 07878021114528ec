"""The engine: facts, rules and ontologies in; closures, answers and explanations out."""

from __future__ import annotations

import warnings
from collections.abc import Collection, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.builtins import BUILTINS, Test
from .ontology.equal import DIFFERENT, SAME_AS, equal_facts, node_kinds
from .operators.fixpoint import MAX_ROUNDS, Fixpoint, Hook, Relations, split_triples
from .operators.provenance import Proof, firing_counts, firings, prove
from .operators.solve import answer, atoms_of, has_var_pred
from .plans.analysis import Safety, Strictness, derived_predicates, hybrid_predicates, safe_rules
from .plans.compiler import Compiler, scan
from .plans.magic import Program, magic_sets
from .plans.model import Atom, Const, Rule, Var
from .plans.query import Query, parse_query
from .sources.notation3 import parse
from .storage import saved
from .terms import TYPE


class Engine:
    """A program over DataFrames.

    Facts are relations by predicate, one column (``s``) for classes and two
    (``s``, ``o``) for properties, of any column types, or triples of canonical
    terms. Everything is a set. Results are DataFrames; the fixpoint runs when
    one is asked for, and again only after something was added.
    """

    def __init__(self, spark: SparkSession, builtins: Mapping[str, Test] | None = None, safety: Safety = Safety.NONE, max_rounds: int = MAX_ROUNDS, prefixes: dict[str, str] | None = None, services: Mapping[str, object] | None = None) -> None:
        self.spark, self.safety, self.max_rounds, self.prefixes = spark, safety, max_rounds, dict(prefixes or {})
        self.builtins = {**BUILTINS, **(builtins or {})}
        self.stored = Relations(spark)
        #: Endpoints by the names that ``SERVICE`` has for them, such as ``<http://...>``.
        self.stored.services = dict(services or {})
        self.rules: list[Rule] = []
        self.constraints: list[tuple] = []
        #: Whether equal nodes have the same facts: an ontology asks for it.
        self.equality = False
        self.hooks: dict[str, tuple[Hook, bool]] = {}
        self._closure: Fixpoint | None = None

    @classmethod
    def from_graph(cls, spark: SparkSession, triples: DataFrame | None = None, ontology: Iterable[tuple[str, str, str]] = (), rules: str | Iterable[Rule] = (), endpoints: Mapping[str, object] | None = None, **options) -> Engine:
        """An engine that entails from data, the axioms of an ontology, and rules at once.

        ``endpoints`` maps predicates to :class:`~ruleweave.sources.endpoint.Endpoint` objects that hold their facts.
        """
        e = cls(spark, **options)
        if triples is not None:
            e.add_triples(triples)
        for pred, endpoint in (endpoints or {}).items():
            e.add_relation(pred, endpoint.facts(pred))
        if axioms := list(ontology):
            e.add_ontology(axioms)
        return e.add_rules(rules)

    # facts and rules

    def add_relation(self, pred: str, facts: DataFrame, unique: bool = False) -> Engine:
        """Facts of one predicate: the one or two columns of ``facts``.

        ``unique`` says that no fact repeats, which saves the shuffle to make it so.
        """
        names = ["s", "o"][: len(facts.columns)]
        if not 1 <= len(facts.columns) <= 2:
            raise ValueError("a relation has one column or two")
        facts = facts.toDF(*names).where(" and ".join(f"{n} is not null" for n in names))
        if pred in self.stored.parts:
            unique = False  # the parts may share facts
        self.stored.add(pred, facts if unique else facts.distinct())
        self._closure = None
        return self

    def add_store(self, path: str) -> Engine:
        """The relations of a store that :func:`ruleweave.sources.store.write_store` wrote."""
        from .sources.store import relations

        for pred, facts in relations(self.spark, path).items():
            plain = pred not in self.stored.parts
            self.add_relation(pred, facts, unique=True)
            if plain:
                self.stored.plain.add(pred)
        return self

    def add_triples(self, triples: DataFrame) -> Engine:
        """Facts as triples (s, p, o) of canonical terms."""
        for pred, facts in split_triples(triples.select("s", "p", "o")).items():
            self.add_relation(pred, facts)
        return self

    def add_rules(self, rules: str | Iterable[Rule]) -> Engine:
        """Rules, or a Notation3 text whose rules and facts are added."""
        if isinstance(rules, str):
            doc = parse(rules, builtins=self.builtins)
            self.prefixes = {**doc.prefixes, **self.prefixes}
            if doc.facts:
                self.add_triples(self.spark.createDataFrame(doc.facts, "s string, p string, o string"))
            for body in doc.constraints:
                warnings.warn("a rule without a head derives nothing; see violations()", stacklevel=2)
                self.constraints.append(body)
            rules = doc.rules
        self.rules += [r for r in safe_rules(rules, self.safety) if r not in self.rules]
        self._closure = None
        return self

    def add_ontology(self, triples: Iterable[tuple[str, str, str]], **options) -> Engine:
        """Rules for the axioms of an ontology (driver-side triples), and its assertions as facts."""
        from .ontology.compile import compile_ontology

        triples = list(triples)
        compiled = compile_ontology(triples, **options)
        if compiled.facts:
            self.add_triples(self.spark.createDataFrame(sorted(compiled.facts), "s string, p string, o string"))
        self.equality |= compiled.equality
        return self.add_rules(compiled.rules)

    def program(self) -> list[Rule]:
        """The rules; where equality matters, also those that give equal nodes the facts of each other, for every relation there is.

        Columns of another type than the equal nodes' hold none of them.
        """
        if not self.equality:
            return self.rules
        kinds = {p: [k for _, k in df.dtypes] for p in self.stored.parts if (df := self.stored.get(p)) is not None}
        for r in self.rules:
            for h in r.heads:
                if not isinstance(h.pred, Var):
                    kinds.setdefault(h.pred, ["string"] * len(h.args))
        stored = kinds[SAME_AS] if SAME_AS in self.stored.parts else []
        nodes = node_kinds(self.rules, kinds) | set(stored) or {"string"}
        out = list(self.rules)
        for p, columns in sorted(kinds.items()):
            if p not in (SAME_AS, DIFFERENT, TYPE):
                out += equal_facts(p, [k in nodes for k in columns])
        return list(dict.fromkeys(out))

    def on_fire(self, rule: Rule | str, hook: Hook, replace: bool = False) -> Engine:
        """Call ``hook`` with the new firings of a rule each round; the triples that it returns are added (instead of the heads, with ``replace``)."""
        self.hooks[rule if isinstance(rule, str) else rule.name] = (hook, replace)
        self._closure = None
        return self

    def reset(self) -> Engine:
        """Forget what was derived."""
        self._closure = None
        return self

    def clear(self) -> Engine:
        """Forget rules and what was derived."""
        self.rules, self.constraints, self.hooks, self.equality = [], [], {}, False
        return self.reset()

    # analysis

    def derived(self, strictness: Strictness = Strictness.LOOSE, given: Collection[str] = (), base: Collection[str] = ()) -> set[str]:
        return derived_predicates(self.program(), set(self.stored.parts), strictness, given, base)

    def hybrid(self) -> set[str]:
        return hybrid_predicates(self.derived(), set(self.stored.parts))

    def _compiler(self, relations: Relations) -> Compiler:
        return Compiler(self.builtins, relations.subjects)

    # evaluation

    def run(self, until: Atom | None = None) -> Fixpoint:
        if self._closure is None or until is not None:
            relations = self.stored.copy()
            closure = Fixpoint(relations, self._compiler(relations), self.hooks, self.max_rounds, until)
            closure.run(self.program())
            if until is not None:
                return closure
            self._closure = closure
        return self._closure

    def closure(self) -> DataFrame:
        """Stored and derived facts as triples."""
        return self.run().relations.triples()

    def inferred(self, without_schema: bool = False) -> DataFrame:
        """Derived facts that were not stored, as triples; ``without_schema`` leaves out types of predicates and classes."""
        found = Relations(self.spark)
        found.parts = dict(self.run().derived)
        out = found.triples()
        if without_schema:  # predicates and classes in use are a vocabulary
            names = sorted(self.run().relations.parts)
            out = out.where((F.col("p") != TYPE) | ~F.col("s").isin(names))
        return out

    def relation(self, pred: str, arity: int = 2) -> DataFrame:
        """The extent of a predicate in the closure."""
        df = self.run().relations.get(pred)
        return df if df is not None else self.run().relations.read(Atom(pred, tuple(Var(f"a{i}") for i in range(arity))))

    def match(self, s: str | None = None, p: str | None = None, o: str | None | Collection[str] = None) -> DataFrame:
        """Triples of the closure by any of their parts; a collection matches each of its members."""
        out = self.closure()
        for name, x in (("s", s), ("p", p), ("o", o)):
            if x is not None:
                out = out.where(F.col(name) == x if isinstance(x, str) else F.col(name).isin(list(x)))
        return out

    def add_facts(self, pred: str, facts: DataFrame) -> Engine:
        """Add facts to a closure and derive only what follows from them; programs with negation start anew."""
        names = ["s", "o"][: len(facts.columns)]
        facts = facts.toDF(*names).distinct()
        if self._closure is None or any(r.negative for r in self.rules):
            return self.add_relation(pred, facts)
        known = self._closure.relations.get(pred)
        new = saved(facts.join(known, names, "left_anti") if known is not None else facts, "added")
        self.stored.add(pred, new)
        self._closure.relations.add(pred, new)
        if not new.isEmpty():
            self._closure.run(self.program(), {pred: new})
        return self

    # goals and queries

    def rewritten(self, goals: list[Atom], no_magic: Collection[str] = ()) -> Program:
        return magic_sets(self.program(), goals, self.derived(), no_magic, set(self.stored.parts))

    def solve_goals(self, goals: list[Atom], no_magic: Collection[str] = ()) -> Relations:
        """Relations with all facts that answer the goals, by magic sets, under the goals' rewritten names too."""
        program = self.rewritten(goals, no_magic)
        relations = self.stored.copy()
        for seed in program.seeds:
            relations.add(seed.pred, self.spark.range(1).select(*[F.lit(t.value).alias(n) for n, t in zip(("s", "o"), seed.args, strict=False)]))
        Fixpoint(relations, self._compiler(relations), {}, self.max_rounds).run(program.rules)
        answers: dict[str, dict[str, DataFrame]] = {}
        for goal, new in zip(goals, program.goals, strict=True):
            if new.pred != goal.pred and (found := relations.get(new.pred)) is not None:
                answers.setdefault(goal.pred, {})[new.pred] = found
        for pred, parts in answers.items():  # a predicate may be asked for in several ways, and have stored facts
            all_parts = [*parts.values(), *([self.stored.get(pred)] if pred in self.stored.parts else [])]
            whole = all_parts[0]
            for x in all_parts[1:]:
                whole = whole.unionByName(x)
            relations.parts[pred] = [whole if len(all_parts) == 1 else whole.distinct()]
        return relations

    def goal(self, atom: Atom) -> DataFrame:
        """The answers to one goal, one column a variable, deriving only what the goal asks for."""
        program = self.rewritten([atom])
        relations = self.stored.copy()
        for seed in program.seeds:
            relations.add(seed.pred, self.spark.range(1).select(*[F.lit(t.value).alias(n) for n, t in zip(("s", "o"), seed.args, strict=False)]))
        Fixpoint(relations, self._compiler(relations), {}, self.max_rounds).run(program.rules)
        return scan(program.goals[0], relations.read(program.goals[0])).distinct()

    def holds(self, atom: Atom) -> bool:
        """Whether a ground goal is in the closure; the rounds stop when it is found."""
        closure = self.run(until=atom)
        return not scan(atom, closure.relations.read(atom)).isEmpty()

    def _relations_for(self, query: Query, fixed: Mapping[str, str]) -> Relations:
        """Stored facts if the query needs no rule; the closure if it is there, or if a pattern or a rule may need any predicate; else by magic sets.

        The goals are the patterns of all groups, with their constants and bindings;
        a derived predicate that no constant binds is evaluated in full, by the rules that it needs.
        """
        atoms = atoms_of(query.where, fixed)
        wild = has_var_pred(atoms) or any(isinstance(h.pred, Var) for r in self.rules for h in r.heads)
        derived = self.derived()
        if not wild and not {a.pred for a in atoms} & derived:
            return self.stored
        if wild or self.hooks or self._closure is not None:
            return self.run().relations
        goals = [a for a in atoms if a.pred in derived]
        free = {a.pred for a in goals if not any(isinstance(t, Const) for t in a.args)}
        return self.solve_goals(list(dict.fromkeys(goals)), free)

    def sparql(self, text: str, bindings: Mapping[str, str] | None = None) -> DataFrame:
        """SELECT: a column a variable; ASK: one row ``answer``. ``bindings`` fix variables beforehand."""
        query, fixed = parse_query(text, self.prefixes), dict(bindings or {})
        if query.variables:
            query.variables = [n for n in query.variables if n not in fixed]
        return answer(query, self._relations_for(query, fixed), fixed)

    def ask(self, text: str) -> bool:
        return bool(self.sparql(text).first()[0])

    def first_answer(self, text: str) -> DataFrame:
        return self.sparql(text).limit(1)

    def violations(self) -> DataFrame:
        """Matches of rules without a head: (constraint, bindings)."""
        relations = self.run().relations
        compiler, out = self._compiler(relations), None
        for i, body in enumerate(self.constraints):
            m = compiler.body(Rule((), body, f"constraint {i}"), relations.read)
            pairs = [x for n in m.columns for x in (F.lit(n), F.col(n).cast("string"))]
            rows = m.select(F.lit(f"constraint {i}").alias("constraint"), F.create_map(*pairs).alias("bindings"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "constraint string, bindings map<string,string>")

    def filtered(self, filter_rules: Iterable[Rule]) -> DataFrame:
        """Inferred facts that the heads of filter rules define, as triples."""
        relations = self.run().relations.copy()
        out = Fixpoint(relations, self._compiler(relations), {}, self.max_rounds)
        out.run(list(filter_rules))
        found = Relations(self.spark)
        found.parts = dict(out.derived)
        return found.triples()

    # explanations

    def firings(self) -> DataFrame:
        """Every firing of every rule over the closure; see :mod:`ruleweave.operators.provenance`."""
        relations = self.run().relations
        return firings(self.program(), relations, self._compiler(relations))

    def firing_counts(self) -> DataFrame:
        return firing_counts(self.firings())

    def why(self, pred: str, *args: str) -> Proof:
        """A proof of one ground fact."""
        goal = (args[0], TYPE, pred) if len(args) == 1 else (args[0], pred, args[1])
        return prove(goal, self.firings(), self.stored.triples())

    def explain(self, goal: Atom | None = None) -> str:
        """The rules as text; with a goal, the rules and seeds of its rewriting."""
        if goal is None:
            return "\n".join(f"{r.name}: {r}" for r in self.rules)
        program = self.rewritten([goal])
        return "\n".join([f"goal {program.goals[0]}", *[f"seed {s}" for s in program.seeds], *map(str, program.rules)])
