"""Ontologies: axioms to rules, normal forms, a language to build them and a printer."""
