"""The reference behaviour of programs on small fixtures."""

import warnings

import pytest
from pyspark.sql import functions as F

from ruleweave.engine import Engine
from ruleweave.operators.fixpoint import NoFixpoint
from ruleweave.operators.provenance import NotDerived
from ruleweave.plans.analysis import NotStratified, Safety, Strictness, UnsafeRule, derived_predicates, strata
from ruleweave.plans.magic import adornment
from ruleweave.plans.model import Atom, Rule, Var, atom, cond, rule

FAMILY = """@keywords a. @prefix : <http://ex#>.
:albert :begat :bill, :bevan. :bill :begat :carol, :charlie. :bertha :begat :carol, :charlie.
:bevan :begat :chaude, :christine. :christine :begat :david, :diana, :douglas.
{ ?x :begat ?y } => { ?y :ancestor ?x }.
{ ?x :ancestor ?y. ?y :ancestor ?z } => { ?x :ancestor ?z }."""
ANCESTOR = "<http://ex#ancestor>"


def ex(name):
    return f"<http://ex#{name}>"


def rows(df):
    return {tuple(r) for r in df.collect()}


def values(df):
    return {r[0] for r in df.collect()}


@pytest.fixture(scope="module")
def family(spark):
    return Engine(spark).add_rules(FAMILY)


def test_family_closure_and_queries(family):
    pairs = rows(family.relation(ANCESTOR))
    assert len(pairs) == 21
    assert {o for s, o in pairs if s == ex("david")} == {ex("albert"), ex("bevan"), ex("christine")}
    assert family.ask("ASK { :david :ancestor :christine }")
    assert not family.ask("ASK { :christine :ancestor :david }")
    assert family.sparql("SELECT ?x ?y WHERE { ?x :ancestor ?y }").count() == 21


def test_goal_directed_equals_closure(family):
    assert values(family.goal(atom(ANCESTOR, ex("david"), "?z"))) == {ex("albert"), ex("bevan"), ex("christine")}
    assert values(family.goal(atom(ANCESTOR, "?z", ex("albert")))) == {r[0] for r in rows(family.relation(ANCESTOR)) if r[1] == ex("albert")}
    assert len(rows(family.goal(atom(ANCESTOR, "?x", "?y")))) == 21
    program = family.rewritten([atom(ANCESTOR, ex("david"), "?z")])
    assert [str(s) for s in program.seeds] == [f"magic_{ANCESTOR}_bf({ex('david')})"]


def test_proofs(family):
    proof = family.why(ANCESTOR, ex("david"), ex("albert"))
    assert proof.rule and proof.depth >= 3
    leaves = [x for x in proof.lines() if "[stored]" in x]
    assert all(":begat" in x or "#begat" in x for x in leaves)
    assert "digraph" in proof.dot() and any("NodeSet" in o for _, _, o in proof.pml())
    with pytest.raises(NotDerived):
        family.why(ANCESTOR, ex("albert"), ex("david"))


def test_incremental_equals_whole(spark):
    e = Engine(spark).add_rules(FAMILY)
    e.run()
    e.add_facts("<http://ex#begat>", spark.createDataFrame([(ex("zed"), ex("albert"))], "s string, o string"))
    whole = Engine(spark).add_rules(FAMILY + " :zed :begat :albert.")
    assert rows(e.relation(ANCESTOR)) == rows(whole.relation(ANCESTOR))


def test_numeric_filters(spark):
    e = Engine(spark).add_rules("""@prefix : <http://ex#>. @prefix math: <http://www.w3.org/2000/10/swap/math#>.
    :a :p1 1; :p2 4. :b :p1 2; :p2 4, 1, 5. :c :p1 7.
    { ?x :p1 ?a; :p2 ?b. ?b math:lessThan ?a } => { ?x a :Selected; :smaller ?b }.
    { ?x :p1 ?a. ?a math:equalTo 7 } => { ?x a :Selected2 }.""")
    one = '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'
    assert values(e.relation(ex("Selected"), 1)) == {ex("b")}
    assert rows(e.relation(ex("smaller"))) == {(ex("b"), one)}
    assert values(e.relation(ex("Selected2"), 1)) == {ex("c")}


def test_numbers_and_strings_are_different_terms(spark):
    e = Engine(spark).add_rules('@prefix : <http://ex#>. :a :v "1". :b :v 1. { ?x :v 1 } => { ?x a :Number }.')
    assert values(e.relation(ex("Number"), 1)) == {ex("b")}


def test_user_filter_and_repeated_variables(spark):
    e = Engine(spark, {"<http://ex#starts>": lambda a, b: F.contains(a, F.lit("ex"))}).add_rules('@prefix : <http://ex#>. :t :value "example". :t :likes :t, :u. { :t :value ?v. ?v :starts "ex" } => { :test :passes 1 }. { ?x :likes ?x } => { ?x a :Vain }.')
    assert e.relation("<http://ex#passes>").count() == 1
    assert values(e.relation(ex("Vain"), 1)) == {ex("t")}


def test_existential_heads_are_one_node_a_match(spark):
    text = """@prefix : <http://ex#>. :d1 a :Detection; :name "Inference1". :d2 a :Detection; :name "Inference2".
    { ?d a :Detection; :name ?n } => { ?d :inference _:i. _:i a :Inference; :iname ?n }."""
    e = Engine(spark).add_rules(text)
    assert e.relation(ex("Inference"), 1).count() == 2
    assert rows(e.relation(ex("iname"))) == rows(Engine(spark).add_rules(text).relation(ex("iname")))


def test_two_rules_with_equal_heads_invent_different_nodes(spark):
    e = Engine(spark).add_rules("@prefix : <http://ex#>. :a :b :c. :d :e :c. { ?x :b ?y } => { _:n :p ?y }. { ?x :e ?y } => { _:n :p ?y }.")
    found = rows(e.relation(ex("p")))
    assert len(found) == 2 and {o for _, o in found} == {ex("c")}


def test_endless_invention_raises(spark):
    e = Engine(spark, max_rounds=4).add_rules([rule([atom("next", "?x", "?y"), atom("N", "?y")], atom("N", "?x"))])
    e.add_relation("N", spark.createDataFrame([("a",)], "s string"))
    with pytest.raises(NoFixpoint):
        e.run()


def test_hooks_replace_and_repropagate(spark):
    e = Engine(spark)
    e.add_relation("mbox", spark.createDataFrame([("p1", "mailto:a"), ("p2", "mailto:b")], "s string, o string"))
    r = rule(atom("placeholder", "?x", "?m"), atom("mbox", "?x", "?m"))
    e.add_rules([r, rule(atom("Hashed", "?x"), atom("sha", "?x", "?h"))])
    e.on_fire(r, lambda m: m.select(F.col("x").alias("s"), F.lit("sha").alias("p"), F.sha1("m").alias("o")), replace=True)
    assert e.relation("sha").count() == 2 and values(e.relation("Hashed", 1)) == {"p1", "p2"}
    assert e.run().relations.get("placeholder") is None


def test_second_order_rules(spark):
    e = Engine(spark).add_rules("@prefix : <http://ex#>. :knows a :Sym. :likes a :Sym. :a :knows :b. :c :likes :d. :e :hates :f. { ?P a :Sym. ?x ?P ?y } => { ?y ?P ?x }.")
    found = rows(e.inferred())
    assert found == {(ex("b"), ex("knows"), ex("a")), (ex("d"), ex("likes"), ex("c"))}


def test_same_generation(spark):
    par = [("a", "p"), ("b", "p"), ("c", "q"), ("p", "r"), ("q", "r")]
    e = Engine(spark).add_relation("par", spark.createDataFrame(par, "s string, o string"))
    e.add_relation("flat", spark.createDataFrame([("r", "r")], "s string, o string"))
    e.add_rules([rule(atom("sg", "?x", "?y"), atom("flat", "?x", "?y")), rule(atom("sg", "?x", "?y"), atom("par", "?x", "?a"), atom("sg", "?a", "?b"), atom("par", "?y", "?b"))])
    assert values(e.goal(atom("sg", "a", "?y"))) == {"a", "b", "c"}


def test_stratified_negation(spark):
    e = Engine(spark).add_relation("edge", spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "s int, o int"))
    e.add_rules([rule(atom("R", "?y"), atom("edge", 1, "?y")), rule(atom("R", "?z"), atom("R", "?y"), atom("edge", "?y", "?z")), rule(atom("U", "?x"), atom("edge", "?x", "?y"), atom("R", "?x", naf=True))])
    assert values(e.relation("U", 1)) == {1, 4}
    assert values(e.goal(atom("U", "?x"))) == {1, 4}
    with pytest.raises(NotStratified):
        strata([rule(atom("A", "?x"), atom("D", "?x"), atom("B", "?x", naf=True)), rule(atom("B", "?x"), atom("D", "?x"), atom("A", "?x", naf=True))])


def test_negation_alone_ranges_over_all_subjects(spark):
    e = Engine(spark).add_relation("Bar", spark.createDataFrame([("a",)], "s string")).add_relation("Foo", spark.createDataFrame([("b",)], "s string"))
    assert values(e.add_rules([rule(atom("Baz", "?x"), atom("Bar", "?x", naf=True))]).relation("Baz", 1)) == {"b"}


def test_safety_modes(spark):
    bad = rule(atom("A", "?z"), atom("B", "?x"))
    with pytest.raises(UnsafeRule):
        Engine(spark, safety=Safety.STRICT).add_rules([bad])
    with pytest.warns(UserWarning):
        assert Engine(spark, safety=Safety.LOOSE).add_rules([bad]).rules == []


def test_predicate_partition():
    rules = [rule(atom("A", "?x"), atom("B", "?x"))]
    assert derived_predicates(rules, {"A", "B"}) == {"A"}
    assert derived_predicates(rules, {"A", "B"}, Strictness.BASE) == set()
    assert derived_predicates(rules, {"A", "B"}, Strictness.DERIVED, base={"A"}) == set()
    with pytest.raises(ValueError):
        derived_predicates(rules, {"A", "B"}, Strictness.HARSH)


def test_hybrid_predicates_answer_from_both(spark):
    e = Engine(spark).add_relation("gp", spark.createDataFrame([("x", "y")], "s string, o string")).add_relation("p", spark.createDataFrame([("a", "b"), ("b", "c")], "s string, o string"))
    e.add_rules([rule(atom("gp", "?a", "?c"), atom("p", "?a", "?b"), atom("p", "?b", "?c"))])
    assert e.hybrid() == {"gp"}
    assert rows(e.relation("gp")) == {("x", "y"), ("a", "c")}
    assert values(e.goal(atom("gp", "x", "?y"))) == {"y"} and values(e.goal(atom("gp", "a", "?y"))) == {"c"}


def test_adornment_and_constants():
    assert adornment(atom("p", "a", "?y")) == "bf"
    assert adornment(atom("p", "?x", "?y"), {"y"}) == "fb"
    assert Atom("p", (Var("x"),)).vars == ("x",)


def test_facts_without_body_and_empty_relations(spark):
    e = Engine(spark).add_rules([Rule((atom("A", "k"),), ()), rule(atom("B", "?x"), atom("A", "?x"), atom("None", "?x"))])
    assert values(e.relation("A", 1)) == {"k"} and e.relation("B", 1).count() == 0


def test_constraints(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        e = Engine(spark).add_rules("@prefix : <http://ex#>. :a :age 200. { ?x :age ?n. ?n <http://www.w3.org/2000/10/swap/math#greaterThan> 150 } => {}.")
    assert e.violations().first()["bindings"]["x"] == ex("a")


def test_early_stop_and_reset(spark):
    e = Engine(spark).add_relation("next", spark.createDataFrame([(i, i + 1) for i in range(8)], "s int, o int"))
    e.add_rules([rule(atom("reach", "?x", "?y"), atom("next", "?x", "?y")), rule(atom("reach", "?x", "?z"), atom("reach", "?x", "?y"), atom("next", "?y", "?z"))])
    assert e.holds(atom("reach", 0, 2)) and not e.holds(atom("reach", 2, 0))
    stopped = e.run(until=atom("reach", 0, 2)).rounds
    assert stopped < e.run().rounds
    assert e.clear().relation("reach").count() == 0


def test_typed_values_never_raise_in_builtins(spark):
    e = Engine(spark).add_relation("v", spark.createDataFrame([("a", "x"), ("b", "12")], "s string, o string"))
    e.add_rules([rule(atom("Big", "?x"), atom("v", "?x", "?n"), cond("math:greaterThan", "?n", 3))])
    assert values(e.relation("Big", 1)) == {"b"}
