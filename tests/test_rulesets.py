"""Rule sets of specifications, ELH classification and declarations."""

import pytest

from ruleweave.engine import Engine
from ruleweave.ontology.elh import NotElh, classify
from ruleweave.ontology.expr import AllOf, Complement, Named, Some
from ruleweave.ontology.rulesets import PD_RULES, RDFS_RULES
from ruleweave.plans.declare import declared_predicates
from ruleweave.plans.magic import sip, sip_dot
from ruleweave.plans.model import atom, rule
from ruleweave.sources.notation3 import parse
from ruleweave.terms import OWL, TYPE, iri


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_rdfs(spark):
    e = Engine(spark).add_rules(RDFS_RULES + """
    @prefix : <http://ex#>. :p rdfs:domain :C; rdfs:subPropertyOf :q. :C rdfs:subClassOf :D. :a :p :b.""")
    found = rows(e.inferred())
    assert {("<http://ex#a>", TYPE, "<http://ex#C>"), ("<http://ex#a>", TYPE, "<http://ex#D>"), ("<http://ex#a>", "<http://ex#q>", "<http://ex#b>")} <= found


def test_pd_star(spark):
    e = Engine(spark).add_rules(PD_RULES + """
    @prefix : <http://ex#>. :key a owl:InverseFunctionalProperty. :a :key "1". :b :key "1". :b :likes :c.""")
    found = rows(e.inferred())
    assert {("<http://ex#a>", iri(OWL + "sameAs"), "<http://ex#b>"), ("<http://ex#a>", "<http://ex#likes>", "<http://ex#c>")} <= found


def test_elh(spark):
    n = Named
    axioms = [
        (n("KneeJoint"), n("Joint")), (n("KneeJoint"), Some("isPartOf", n("Leg"))), (n("Leg"), n("Limb")),
        (AllOf((n("Joint"), Some("isPartOf", n("Limb")))), n("LimbJoint")), (n("LimbJoint"), Some("near", n("Bone"))), (Some("by", n("Bone")), n("Bony")),
    ]
    found = rows(classify(spark, axioms, [("near", "by")]))
    assert {("KneeJoint", "LimbJoint"), ("KneeJoint", "Joint"), ("KneeJoint", "Bony"), ("LimbJoint", "Bony")} <= found
    assert ("Joint", "LimbJoint") not in found and ("Leg", "Bony") not in found
    with pytest.raises(NotElh):
        classify(spark, [(n("A"), Complement(n("B")))])


def test_declarations():
    d = parse("""@prefix d: <tag:declarations#>. @prefix : <http://ex#>. @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
    ( :A :B ) a d:DerivedClassList. ( :B ) a d:BaseClassList. ( <http://ex#p> ) a d:DerivedPropertyPrefix. :q a d:DerivedClassQuery; rdf:value "SELECT ?c { ?c a :K }".""").facts
    onto = parse("@prefix : <http://ex#>. @prefix owl: <http://www.w3.org/2002/07/owl#>. :p1 a owl:ObjectProperty. :r a owl:ObjectProperty.").facts
    ex = lambda x: f"<http://ex#{x}>"
    assert declared_predicates(d, onto, [], lambda q: [ex("Q")] if "SELECT" in q else []) == {ex("A"), ex("p1"), ex("Q")}


def test_bindings_pass_into_the_class_atom():
    r = rule(atom("Good", "?m"), atom("type", "?p", "principal"), atom("role", "?p", "actress"), atom("of", "?p", "?m"), atom("Movie", "?m"))
    _, arcs = sip(r, r.heads[0], "b")
    (arc,) = [a for a in arcs if a.target.pred == "Movie"]
    assert arc.variables == ("m",) and "digraph" in sip_dot(r, r.heads[0], "b")


def test_store_is_pruned_by_predicate(spark, tmp_path):
    from ruleweave.sources.store import read_store, relations, write_store

    data = [("<a>", "<p>", "<b>"), ("<a>", "<q>", "<c>"), ("<a>", TYPE, "<C>"), ("<b>", TYPE, "<D>"), ("<a>", "<p>", "<b>")]
    path = str(tmp_path / "store")
    write_store(spark.createDataFrame(data, "s string, p string, o string"), path)
    assert rows(read_store(spark, path)) == set(data)
    assert rows(relations(spark, path)["<C>"]) == {("<a>",)}
    e = Engine(spark).add_store(path).add_rules([rule(atom("<R>", "?x"), atom("<p>", "?x", "?y"), atom("<D>", "?y"))])
    assert rows(e.relation("<R>", 1)) == {("<a>",)}
    plan = relations(spark, path)["<p>"].where("s = '<a>'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(s,<a>)" in plan
