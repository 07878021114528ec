"""N-Triples files and triple tables, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import IMPLIES

TRIPLES = "s string, p string, o string"
#: A line of the format: subject, predicate, object (fixed value).
_LINE = r'^\s*(<[^>]*>|_:\S+)\s*(<[^>]*>)\s*(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


class Malformed(ValueError):
    """Lines that are no triples."""


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Triples (s, p, o) of N-Triples files of any size; ``strict`` raises if a line is malformed, else it is left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select("value", *[F.regexp_extract("value", _LINE, i + 1).alias(n) for i, n in enumerate("spo")])
    if strict and (bad := parts.where("p = ''").limit(1).collect()):
        raise Malformed(bad[0][0])
    return parts.where("p != ''").where(F.col("p") != IMPLIES).select("s", "p", F.regexp_replace("o", r'\^\^<http://www\.w3\.org/2001/XMLSchema#string>$', "").alias("o"))


def write(triples: DataFrame, path: str) -> None:
    """Write (s, p, o) as N-Triples."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(path)


def to_turtle(rows: list[tuple[str, str, str]], prefixes: dict[str, str] | None = None) -> str:
    """Turtle of a few triples, grouped by subject (on the driver)."""
    known = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def short(t: str) -> str:
        for name, at in known:
            if t.startswith(f"<{at}") and t[1 + len(at) : -1].replace("_", "").isalnum():
                return f"{name}:{t[1 + len(at) : -1]}"
        return t

    out = [f"@prefix {n}: <{at}> ." for n, at in sorted((prefixes or {}).items())]
    by: dict[str, list[str]] = {}
    for s, p, o in sorted(set(rows)):
        by.setdefault(s, []).append(f"{short(p)} {short(o)}")
    return "\n".join(out + [f"{short(s)} " + " ;\n    ".join(x) + " ." for s, x in by.items()]) + "\n"
