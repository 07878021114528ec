"""Rule sets of public specifications, as Notation3 text for the rule engine."""

from __future__ import annotations

# Entailment rules as the specifications number them.

#: RDFS entailment (rdfs2, 3, 5, 6 to 11 of the RDF semantics).
RDFS_RULES = """
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>.
{ ?p rdfs:domain ?c. ?x ?p ?y } => { ?x rdf:type ?c }.
{ ?p rdfs:range ?c. ?x ?p ?y } => { ?y rdf:type ?c }.
{ ?p rdfs:subPropertyOf ?q. ?q rdfs:subPropertyOf ?r } => { ?p rdfs:subPropertyOf ?r }.
{ ?p rdf:type rdf:Property } => { ?p rdfs:subPropertyOf ?p }.
{ ?p rdfs:subPropertyOf ?q. ?x ?p ?y } => { ?x ?q ?y }.
{ ?c rdf:type rdfs:Class } => { ?c rdfs:subClassOf rdfs:Resource }.
{ ?c rdfs:subClassOf ?d. ?x rdf:type ?c } => { ?x rdf:type ?d }.
{ ?c rdf:type rdfs:Class } => { ?c rdfs:subClassOf ?c }.
{ ?c rdfs:subClassOf ?d. ?d rdfs:subClassOf ?e } => { ?c rdfs:subClassOf ?e }.
"""

#: What RDFS says of every triple and of the vocabulary itself (rdf1, rdfs4, 12 and 13): it types all that there is, so it stands apart.
RDFS_AXIOM_RULES = """
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>.
@prefix term: <term:>.
{ ?x ?p ?y } => { ?p rdf:type rdf:Property }.
{ ?x ?p ?y } => { ?x rdf:type rdfs:Resource }.
{ ?x ?p ?y. ?y term:isResource ?y } => { ?y rdf:type rdfs:Resource }.
{ ?p rdf:type rdfs:ContainerMembershipProperty } => { ?p rdfs:subPropertyOf rdfs:member }.
{ ?d rdf:type rdfs:Datatype } => { ?d rdfs:subClassOf rdfs:Literal }.
"""

#: The pD* extension of RDFS by part of OWL (rdfp1 to rdfp16).
PD_RULES = """
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>.
@prefix owl: <http://www.w3.org/2002/07/owl#>.
@prefix log: <http://www.w3.org/2000/10/swap/log#>.
{ ?p rdf:type owl:FunctionalProperty. ?u ?p ?v. ?u ?p ?w. ?v log:notEqualTo ?w } => { ?v owl:sameAs ?w }.
{ ?p rdf:type owl:InverseFunctionalProperty. ?u ?p ?w. ?v ?p ?w. ?u log:notEqualTo ?v } => { ?u owl:sameAs ?v }.
{ ?p rdf:type owl:SymmetricProperty. ?v ?p ?w } => { ?w ?p ?v }.
{ ?p rdf:type owl:TransitiveProperty. ?u ?p ?v. ?v ?p ?w } => { ?u ?p ?w }.
{ ?v owl:sameAs ?w } => { ?w owl:sameAs ?v }.
{ ?u owl:sameAs ?v. ?v owl:sameAs ?w } => { ?u owl:sameAs ?w }.
{ ?p owl:inverseOf ?q. ?v ?p ?w } => { ?w ?q ?v }.
{ ?p owl:inverseOf ?q. ?v ?q ?w } => { ?w ?p ?v }.
{ ?v rdf:type owl:Class. ?v owl:sameAs ?w } => { ?v rdfs:subClassOf ?w }.
{ ?p rdf:type rdf:Property. ?p owl:sameAs ?q } => { ?p rdfs:subPropertyOf ?q }.
{ ?u ?p ?v. ?u owl:sameAs ?x } => { ?x ?p ?v }.
{ ?u ?p ?v. ?v owl:sameAs ?y } => { ?u ?p ?y }.
{ ?v owl:equivalentClass ?w } => { ?v rdfs:subClassOf ?w. ?w rdfs:subClassOf ?v }.
{ ?v rdfs:subClassOf ?w. ?w rdfs:subClassOf ?v } => { ?v owl:equivalentClass ?w }.
{ ?v owl:equivalentProperty ?w } => { ?v rdfs:subPropertyOf ?w. ?w rdfs:subPropertyOf ?v }.
{ ?v rdfs:subPropertyOf ?w. ?w rdfs:subPropertyOf ?v } => { ?v owl:equivalentProperty ?w }.
{ ?v owl:hasValue ?w. ?v owl:onProperty ?p. ?u rdf:type ?v } => { ?u ?p ?w }.
{ ?v owl:hasValue ?w. ?v owl:onProperty ?p. ?u ?p ?w } => { ?u rdf:type ?v }.
{ ?v owl:someValuesFrom ?w. ?v owl:onProperty ?p. ?u ?p ?x. ?x rdf:type ?w } => { ?u rdf:type ?v }.
{ ?v owl:allValuesFrom ?w. ?v owl:onProperty ?p. ?u rdf:type ?v. ?u ?p ?x } => { ?x rdf:type ?w }.
"""
