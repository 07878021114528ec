"""Parsers, ontologies, other sources, streaming and the command line."""

import json

import pytest

from ruleweave.__main__ import main
from ruleweave.engine import Engine
from ruleweave.ontology import dsl
from ruleweave.ontology.dsl import AnnotationProperty, Class, Property, exactly, minimum, only, some, value
from ruleweave.ontology.compile import compile_ontology
from ruleweave.ontology.expr import AllOf, AnyOf, Complement, HasValue, Named, OneOf, Only, Some, expand_complements, manchester, normal_form, read, write
from ruleweave.ontology.graph import Graph
from ruleweave.operators.equality import representatives, rewritten
from ruleweave.plans.model import And, Atom, Not, Or, Var, atom, rule
from ruleweave.plans.normal import merged_inclusions, rules_of
from ruleweave.plans.query import QueryProblem, parse_query
from ruleweave.sources.endpoint import Endpoint, EndpointProblem, results, to_sparql
from ruleweave.sources.notation3 import SyntaxProblem, parse
from ruleweave.sources.ntriples import Malformed, read as read_nt, to_turtle, write as write_nt
from ruleweave.sources.rdfxml import parse_rdfxml
from ruleweave.sources.rif import RifProblem, parse_rif
from ruleweave.streaming.incremental import StreamingClosure
from ruleweave.terms import OWL, RDF, RDFS, TYPE, iri, literal, parsed

E_ = "http://ex#"


def ex(name):
    return iri(E_ + name)


def rows(df):
    return {tuple(r) for r in df.collect()}


def owl(name):
    return iri(OWL + name)


# Notation3


def test_notation3_facts():
    doc = parse(f"""@prefix : <{E_}>. # a comment
    :a a :C; :p :b, "x\\"y"@en-GB, 1.5, true, 'z'^^:t ; :q [ :r ( 1 :b ) ]. :a = :c. :x @is :p @of :y . """)
    f = set(doc.facts)
    assert (ex("a"), TYPE, ex("C")) in f and (ex("a"), ex("p"), '"x\\"y"@en-gb') in f and (ex("a"), owl("sameAs"), ex("c")) in f
    assert (ex("y"), ex("p"), ex("x")) in f
    assert (ex("a"), ex("p"), f'"z"^^{ex("t")}') in f and sum(p == iri(RDF + "first") for _, p, _ in f) == 2
    assert parsed(literal('a"b\n')) == ("literal", 'a"b\n', None, None)


def test_notation3_rules_and_errors():
    doc = parse(f"@prefix : <{E_}>. {{ ?x :p _:b. _:b a :C }} => {{ ?x a :D }}. {{ ?y a :D }} <= {{ ?y a :E }}.")
    assert len(doc.rules) == 2 and len(doc.rules[0].body_vars) == 2
    assert str(doc.rules[1]) == f"{ex('D')}(?y) :- {ex('E')}(?y)"
    for bad in (":a :b :c", "@prefix : <x>. :a :b ?c.", "@prefix : <x>. { :a :b { :c :d :e } } => { :f :g :h }.", "@prefix : <x>. :a :b"):
        with pytest.raises(SyntaxProblem):
            parse(bad)


def test_ntriples_round_trip(spark, tmp_path):
    data = [(ex("a"), ex("p"), '"x y"@en'), ("_:b", ex("p"), literal(3)), (ex("a"), TYPE, ex("C"))]
    write_nt(spark.createDataFrame(data, "s string, p string, o string"), str(tmp_path / "t"))
    assert rows(read_nt(spark, str(tmp_path / "t"), strict=True)) == set(data)
    (tmp_path / "bad.nt").write_text("<a> <b> .\n")
    assert read_nt(spark, str(tmp_path / "bad.nt")).count() == 0
    with pytest.raises(Malformed):
        read_nt(spark, str(tmp_path / "bad.nt"), strict=True)
    assert set(parse(to_turtle(data, {"e": E_})).facts) >= {data[0], data[2]}


def test_rdfxml():
    text = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{E_}" xml:base="http://b/doc"><e:C rdf:about="#a" e:name="n"><e:p rdf:resource="{E_}b"/>
    <e:q rdf:parseType="Collection"><rdf:Description rdf:about="{E_}x"/></e:q><e:r xml:lang="en">hi</e:r><e:s rdf:datatype="{E_}t">1</e:s></e:C></rdf:RDF>"""
    f = set(parse_rdfxml(text))
    a = "<http://b/doc#a>"
    assert {(a, TYPE, ex("C")), (a, ex("name"), '"n"'), (a, ex("p"), ex("b")), (a, ex("r"), '"hi"@en'), (a, ex("s"), f'"1"^^{ex("t")}')} <= f
    assert any(p == iri(RDF + "first") and o == ex("x") for _, p, o in f)


def test_rif_core():
    ns = 'xmlns="http://www.w3.org/2007/rif#"'
    c = lambda n: f'<Const type="http://www.w3.org/2007/rif#iri">{E_}{n}</Const>'
    text = f"""<Document {ns}><payload><Group><sentence><Forall><declare><Var>x</Var></declare><formula><Implies>
    <if><Or><formula><Frame><object><Var>x</Var></object><slot>{c("p")}{c("b")}</slot></Frame></formula><formula><Member><instance><Var>x</Var></instance><class>{c("C")}</class></Member></formula></Or></if>
    <then><Atom><op>{c("D")}</op><args><Var>x</Var></args></Atom></then></Implies></formula></Forall></sentence></Group></payload></Document>"""
    assert {str(r) for r in parse_rif(text)} == {f"{ex('D')}(?x) :- {ex('p')}(?x, {ex('b')})", f"{ex('D')}(?x) :- {ex('C')}(?x)"}
    with pytest.raises(RifProblem):
        parse_rif(text.replace("Frame", "Frume"))


# conditions


def test_lloyd_topor_and_negation():
    a, b, c, d = (atom(n, "?x") for n in "ABCD")
    assert [r.body for r in rules_of(d, And((a, Or((b, c)))))] == [(a, b), (a, c)]
    assert [[x.naf for x in r.body] for r in rules_of(d, And((a, Not(Or((b, c))))))] == [[False, True, True]]
    assert len(rules_of(And((c, d)), a, split_heads=True)) == 2
    assert merged_inclusions([rule(d, a), rule(d, b), rule(c, a)]) == {"D": ["A", "B"]}


# ontologies


def test_disjunctive_inclusion_has_two_rules():
    g = Graph()
    g.add(write(g, AllOf((Named("Foo"), AnyOf((Named("Omega"), Named("Alpha")))))), iri(RDFS + "subClassOf"), "Bar")
    assert {str(r) for r in compile_ontology(sorted(g.triples)).rules} == {"Bar(?X) :- Foo(?X), Omega(?X)", "Bar(?X) :- Foo(?X), Alpha(?X)"}


def test_equivalence_value_and_existential():
    assert len(compile_ontology([("Foo", owl("equivalentClass"), "Bar")]).rules) == 2
    g = Graph()
    g.add(write(g, AllOf((HasValue("someProp", "fish"), Named("Bar")))), iri(RDFS + "subClassOf"), "Foo")
    g.add("Foo", iri(RDFS + "subClassOf"), write(g, Some("eats", Named("Plant"))))
    found = compile_ontology(sorted(g.triples)).rules
    assert {str(r) for r in found} == {"Foo(?X) :- someProp(?X, fish), Bar(?X)", "eats(?X, ?Y1) & Plant(?Y1) :- Foo(?X)"}


def test_negated_definition(spark):
    g = Graph([("i1", TYPE, "Omega"), ("i2", TYPE, "Omega"), ("i2", TYPE, "Bar")])
    g.add("Foo", owl("equivalentClass"), write(g, AllOf((Named("Omega"), Complement(AnyOf((Named("Bar"), Named("Baz"))))))))
    e = Engine(spark).add_ontology(sorted(g.triples), derived=["Foo"])
    assert [str(r) for r in e.rules] == ["Foo(?X) :- Omega(?X), not Bar(?X), not Baz(?X)"]
    assert rows(e.relation("Foo", 1)) == {("i1",)}


def test_class_cycle_and_transitive_path(spark):
    sub = iri(RDFS + "subClassOf")
    e = Engine(spark).add_ontology([("A", sub, "B"), ("B", sub, "A"), ("i", TYPE, "B")])
    assert rows(e.relation("A", 1)) == {("i",)}
    e = Engine(spark).add_ontology([(ex("path"), TYPE, owl("TransitiveProperty")), (ex("Ghent"), ex("path"), ex("Antwerp")), (ex("Antwerp"), ex("path"), ex("Amsterdam"))])
    e.prefixes[""] = E_
    assert e.ask("ASK { :Ghent :path :Amsterdam }") and not e.ask("ASK { :Antwerp :path :Ghent }")


def test_properties_and_same_as(spark):
    sub, dom = iri(RDFS + "subPropertyOf"), iri(RDFS + "domain")
    e = Engine(spark).add_ontology([("brother", sub, "sibling"), ("hasBrother", owl("equivalentProperty"), "brother"), ("brother", dom, "Person"), ("john", "hasBrother", "jack"), ("jack", "brother", "john")])
    assert ("john", "jack") in rows(e.relation("sibling")) and ("jack", "john") in rows(e.relation("hasBrother")) and ("john",) in rows(e.relation("Person", 1))
    e = Engine(spark).add_ontology([("foo", owl("sameAs"), "bar"), ("bar", owl("sameAs"), "baz"), ("foo", "p", "v")])
    same = rows(e.relation(owl("sameAs")))
    assert {o for s, o in same if s == "baz"} == {"foo", "bar"} and ("baz", "v") in rows(e.relation("p"))
    reps = representatives(spark.createDataFrame([("foo", "bar"), ("bar", "baz")], "s string, o string"))
    assert {r for _, r in rows(reps)} == {"bar"}
    assert rows(rewritten(spark.createDataFrame([("foo", "v"), ("baz", "v")], "s string, o string"), reps)) == {("bar", "v")}


def test_literals_are_no_range_members(spark):
    e = Engine(spark).add_ontology([("p", iri(RDFS + "range"), "C"), ("a", "p", '"text"'), ("a", "p", "b")])
    assert rows(e.relation("C", 1)) == {("b",)}


def test_one_of_differences_and_schema_rules(spark):
    g = Graph()
    g.add(ex("Near"), owl("oneOf"), g.make_list(["a", "b"]))
    g.add("d", TYPE, owl("AllDifferent"))
    g.add("d", owl("distinctMembers"), g.make_list(["a", "b"]))
    got = compile_ontology(sorted(g.triples))
    assert {("a", TYPE, ex("Near")), ("a", owl("differentFrom"), "b"), ("b", owl("differentFrom"), "a")} <= got.facts
    e = Engine(spark).add_ontology([("A", iri(RDFS + "subClassOf"), "B"), ("B", iri(RDFS + "subClassOf"), "C")], owl_rules=True)
    assert ("A", "C") in rows(e.relation(iri(RDFS + "subClassOf")))


def test_normal_forms_and_printing():
    assert normal_form(Some("p", OneOf(("a", "b")))) == AnyOf((HasValue("p", "a"), HasValue("p", "b")))
    assert normal_form(Only("p", Named("C"))) == Complement(Some("p", Complement(Named("C"))))
    assert normal_form(Complement(Complement(Named("C")))) == Named("C")
    assert normal_form(Complement(AnyOf((Named("A"), Named("B"))))) == AllOf((Complement(Named("A")), Complement(Named("B"))))
    assert normal_form(AllOf((Named("A"), AllOf((Named("B"), Named("C")))))) == AllOf((Named("A"), Named("B"), Named("C")))
    assert normal_form(Only("p", OneOf(("a",))), {"p": ("a", "b", "c")}) == AllOf((Complement(HasValue("p", "b")), Complement(HasValue("p", "c"))))
    assert expand_complements(AllOf((Named("U"), Complement(Named("A")))), {"U": ("A", "B")}) == Named("B")
    assert manchester(AllOf((Named(ex("A")), Some(ex("p"), OneOf((ex("b"),)))))) == "A and (p some {b})"


def test_ontology_language():
    g = Graph()
    ns = dsl.Names(g, E_)
    eats = dsl.Property(g, ex("eats"))
    ns.Animal.sub_class_of = [eats.some(ns.Plant | ns.Animal)]
    herb = ns.Herbivore
    herb.equivalent_class = [ns.Animal & ~ns.Carnivore]
    animal = ns.Animal
    animal += [herb]
    assert herb.parents == [ex("Animal")] and not herb.is_primitive() and ns.Plant.is_primitive()
    assert "Animal and (not Carnivore)" in herb.manchester()
    assert read(g, eats.exactly(2, ns.Plant).node).n == 2 and read(g, eats.min(1).node).filler is None
    b = dsl.BooleanClass(g, ex("Both"), [ns.Plant, ns.Animal])
    b.change_operator()
    assert isinstance(b.definition, AnyOf)
    me = dsl.Individual(g, ex("me"), ex("Animal"))
    me.label("I", "en")
    assert animal.extent == [ex("me")] and me.labels == ['"I"@en']
    me.rename(ex("you"))
    assert animal.extent == [ex("you")]
    animal -= herb
    assert animal.sub_sumptee_ids == []
    dsl.deep_clear(g, ex("Herbivore"))
    assert herb.is_primitive() and dsl.component_terms(AllOf((Named("A"), Complement(Named("B"))))) == {"A", "B"}
    assert {c.node for c in dsl.all_classes(g)} >= {ex("Animal"), ex("Plant")} and dsl.all_properties(g) == [ex("eats")]
    o = dsl.Ontology(g, ex("o"))
    o.version = "1"
    o.add_import(ex("other"))
    assert o.version == '"1"' and o.imports == [ex("other")]


# queries


def test_query_language(spark):
    e = Engine(spark).add_rules(f'@prefix : <{E_}>. :a :p 1; :n "Ann". :b :p 5; :n "Bob". :c :n "Cy". {{ ?x :p ?v }} => {{ ?x a :Has }}.')
    assert [r[0] for r in e.sparql("SELECT ?n { ?x a :Has ; :n ?n } ORDER BY DESC(?n)").collect()] == ['"Bob"', '"Ann"']
    assert rows(e.sparql("SELECT ?x { ?x :n ?n OPTIONAL { ?x :p ?v } FILTER(!bound(?v) || ?v >= 5) }")) == {(ex("b"),), (ex("c"),)}
    assert rows(e.sparql('SELECT ?x ?k { ?x :n ?n . BIND(strlen(?n) AS ?k) FILTER regex(?n, "^C") }')) == {(ex("c"), 2)}
    assert e.sparql("SELECT ?x { ?x :n ?n } LIMIT 2 OFFSET 1").count() == 2
    assert rows(e.sparql("SELECT ?p { :c ?p ?o }")) == {(ex("n"),)}
    assert rows(e.match(p=ex("n"), o=['"Cy"'])) == {(ex("c"), ex("n"), '"Cy"')}
    for bad in ("CONSTRUCT { ?s ?p ?o } { ?s ?p ?o }", "SELECT { ?s ?p ?o }", "SELECT ?x { ?x zz:p ?y }"):
        with pytest.raises(QueryProblem):
            parse_query(bad)


# endpoint


def test_endpoint(spark):
    def page(text):
        values = [] if "OFFSET 2" in text else [{"s": {"type": "uri", "value": E_ + "a"}, "o": {"type": "literal", "value": str(i), "datatype": "http://t"}} for i in range(2)]
        return json.dumps({"head": {"vars": ["s", "o"]}, "results": {"bindings": values}}) if "ASK" not in text else '{"boolean": true}'

    e = Endpoint(spark, page, page=2)
    assert rows(e.facts(ex("p"))) == {(ex("a"), '"0"^^<http://t>'), (ex("a"), '"1"^^<http://t>')}
    assert e.holds(ex("p"), ex("a"), ex("b"))
    assert "SERVICE <http://s>" in to_sparql([Atom(ex("C"), (Var("x"),))], ["x"], "http://s")
    with pytest.raises(EndpointProblem):
        results("<html>")


def test_endpoint_pages_are_written_as_they_come(spark, monkeypatch):
    from ruleweave.sources import endpoint

    monkeypatch.setattr(endpoint, "HELD_PAGES", 2)

    def page(text):
        at = int(text.rsplit("OFFSET ", 1)[1])
        return json.dumps({"head": {"vars": ["s", "o"]}, "results": {"bindings": [{x: {"type": "uri", "value": f"{E_}{x}{i}"} for x in "so"} for i in range(at, min(at + 3, 17))]}})

    assert rows(Endpoint(spark, page, page=3).facts(ex("p"))) == {(ex(f"s{i}"), ex(f"o{i}")) for i in range(17)}


def test_data_axioms_rules_and_an_endpoint_at_once(spark):
    def page(text):
        return json.dumps({"head": {"vars": ["s", "o"]}, "results": {"bindings": [{"s": {"type": "uri", "value": E_ + "b"}, "o": {"type": "uri", "value": E_ + "c"}}]}})

    data = spark.createDataFrame([(ex("a"), ex("p"), ex("b"))], "s string, p string, o string")
    e = Engine.from_graph(spark, data, [(ex("p"), iri(RDFS + "subPropertyOf"), ex("q"))], f"@prefix : <{E_}>. {{ ?x :q ?y. ?y :r ?z }} => {{ ?x :s ?z }}.", {ex("r"): Endpoint(spark, page, page=2)})
    assert rows(e.relation(ex("s"))) == {(ex("a"), ex("c"))}


def test_a_service_within_a_query(spark):
    asked = []

    def remote(text):
        asked.append(text)
        return json.dumps({"head": {"vars": ["y", "z"]}, "results": {"bindings": [{"y": {"type": "uri", "value": E_ + y}, "z": {"type": "literal", "value": z}} for y, z in (("b", "one"), ("c", "two"))]}})

    data = spark.createDataFrame([(ex("a"), ex("p"), ex("b")), (ex("a"), ex("p"), ex("d"))], "s string, p string, o string")
    e = Engine(spark, services={"<http://far>": Endpoint(spark, remote)}, prefixes={"": E_}).add_triples(data)
    e.add_rules(f"@prefix : <{E_}>. {{ ?x :p ?y }} => {{ ?x :q ?y }}.")
    assert rows(e.sparql("SELECT ?x ?z WHERE { ?x :q ?y SERVICE <http://far> { ?y :name ?z } }")) == {(ex("a"), '"one"')}
    assert len(asked) == 1 and f"?y {ex('name')} ?z" in asked[0]
    with pytest.raises(QueryProblem):
        e.sparql("SELECT ?z WHERE { SERVICE <http://other> { ?y :name ?z } }")


def test_infix_operators_and_annotation_properties():
    g = Graph()
    has, person = Property(g, ex("has")), Class(g, ex("Person"))
    assert (has |some| person).expression == has.some(person).expression and (has |only| person).expression == has.only(person).expression
    assert (has |value| ex("x")).expression == has.value(ex("x")).expression
    assert (has |minimum| 2).expression == has.min(2).expression and (has |exactly[2]| person).expression == has.exactly(2, person).expression
    with pytest.raises(TypeError):
        some[2]
    note = AnnotationProperty(g, ex("note"))
    note.annotate(person, "a being", "en")
    assert note.of(person) == ['"a being"@en'] and not compile_ontology(sorted(g.triples)).rules


def test_command_line_with_builtins_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "b.py").write_text("BUILTINS = {'<http://ex#longer>': lambda a, b: a.cast('string') > b.cast('string')}")
    monkeypatch.setattr("sys.stdin", io.StringIO(f"@prefix : <{E_}>. :a :p 'x'. :b :p 'z'. {{ ?s :p ?o. ?o :longer 'y' }} => {{ ?s a :Late }}."))
    assert main(["facts", "--data", "-", "--builtins", str(tmp_path / "b.py")], spark) == 0
    assert capsys.readouterr().out.split() == [ex("b"), TYPE, ex("Late"), "."]


# streaming


def test_streaming_closure_equals_batch(spark, tmp_path):
    edges = [(i, i + 1) for i in range(6)]
    for k in range(3):
        spark.createDataFrame(edges[2 * k : 2 * k + 2], "s int, o int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = Engine(spark).add_relation("next", spark.createDataFrame([(6, 7)], "s int, o int"))
    e.add_rules([rule(atom("reach", "?x", "?y"), atom("next", "?x", "?y")), rule(atom("reach", "?x", "?z"), atom("reach", "?x", "?y"), atom("next", "?y", "?z"))])
    closure = StreamingClosure(e, "next")
    stream = spark.readStream.schema("s int, o int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closure.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert closure.batches >= 3 and e.relation("reach").count() == 28


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.n3").write_text(f"@prefix : <{E_}>. :a :p :b. {{ ?x :p ?y }} => {{ ?y :q ?x }}.")
    at = ["--rules", str(tmp_path / "r.n3")]
    assert main(["facts", *at], spark) == 0 and capsys.readouterr().out == f"{ex('b')} {ex('q')} {ex('a')} .\n"
    main(["query", *at, "ASK { :b :q :a }"], spark)
    assert capsys.readouterr().out == "true\n"
    main(["proof", *at, ex("b"), ex("q"), ex("a")], spark)
    assert "[stored]" in capsys.readouterr().out
    main(["rules", *at], spark)
    assert ":-" in capsys.readouterr().out
