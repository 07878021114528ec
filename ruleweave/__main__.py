"""``python -m ruleweave facts|query|proof|rules``: small programs from files.

facts: the inferred triples (or the closure) of data and rules. query: the answers
to a graph query. proof: why a fact holds. rules: the program, rewritten for a goal
if one is given.
"""

from __future__ import annotations

import argparse
import runpy
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.analysis import Safety
from .plans.query import parse_query
from .sources.notation3 import parse
from .sources.ntriples import read, to_turtle
from .sources.rdfxml import parse_rdfxml
from .sources.rif import parse_rif
from .terms import TYPE


def more_builtins(path: str | None) -> dict:
    """The mapping ``BUILTINS`` (name to Column test) of a Python file."""
    return runpy.run_path(path)["BUILTINS"] if path else {}


def build(spark: SparkSession, args: argparse.Namespace) -> Engine:
    e = Engine(spark, more_builtins(args.builtins), safety=Safety(args.safety))
    for path in args.data:
        if path == "-":
            e.add_rules(sys.stdin.read())
        elif path.endswith(".nt"):
            e.add_triples(read(spark, path))
        elif path.endswith((".rdf", ".xml", ".owl")):
            e.add_triples(spark.createDataFrame(parse_rdfxml(Path(path).read_text()), "s string, p string, o string"))
        elif path.endswith(".parquet"):
            e.add_triples(spark.read.parquet(path))
        else:
            e.add_rules(Path(path).read_text())
    for path in args.rules:
        text = Path(path).read_text()
        e.add_rules(parse_rif(text) if path.endswith((".rif", ".xml")) else text)
    for path in args.ontology:
        text = Path(path).read_text()
        e.add_ontology(parse_rdfxml(text) if path.endswith((".rdf", ".owl", ".xml")) else parse(text).facts)
    return e


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ruleweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("facts", "query", "proof", "rules"):
        p = sub.add_parser(name)
        p.add_argument("--data", action="append", default=[], help="facts: .nt, .ttl, .n3, .rdf or .parquet, or - for Notation3 from the standard input")
        p.add_argument("--builtins", help="a Python file whose BUILTINS maps names to tests over columns")
        p.add_argument("--rules", action="append", default=[], help="rules: .n3 or RIF-Core XML")
        p.add_argument("--ontology", action="append", default=[], help="an ontology: .ttl, .n3 or .rdf")
        p.add_argument("--safety", choices=[s.value for s in Safety], default="none")
        p.add_argument("--closure", action="store_true", help="facts: stored ones too")
        p.add_argument("--format", choices=["nt", "ttl", "dot", "text"], default="nt")
        p.add_argument("text", nargs="*", help="the query, or the parts of a fact or goal")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ruleweave").getOrCreate()
    e = build(spark, args)
    if args.command == "facts":
        found = (e.closure() if args.closure else e.inferred()).orderBy("s", "p", "o")
        if args.format == "ttl":  # a text for people, made on the driver
            print(to_turtle([tuple(r) for r in found.collect()], {k: x for k, x in e.prefixes.items() if k}))
        else:
            for s, p, o in found.toLocalIterator():
                print(f"{s} {p} {o} .")
    elif args.command == "query":
        df = e.sparql(args.text[0])
        if parse_query(args.text[0], e.prefixes).kind == "ASK":
            print(str(df.first()[0]).lower())
        else:
            print("\t".join(df.columns))
            for r in df.toLocalIterator():
                print("\t".join(x or "" for x in r))
    elif args.command == "proof":
        s, p, o = args.text
        proof = e.why(o, s) if p == TYPE else e.why(p, s, o)
        print(proof.dot() if args.format == "dot" else "\n".join(proof.lines()))
    else:
        print(e.explain())
    return 0


if __name__ == "__main__":
    sys.exit(main())
