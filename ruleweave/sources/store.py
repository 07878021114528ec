"""Triple stores on disk: Parquet partitioned by predicate, so that a rule's scan reads its predicates' files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import TYPE


def write_store(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Write (s, p, o); facts of a class lie under ``rdf:type`` and the class, those of a property under it."""
    cls = F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.lit(""))
    triples.select("s", "o", "p", cls.alias("class")).distinct().write.mode(mode).partitionBy("p", "class").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All triples (s, p, o) of a store."""
    return spark.read.parquet(path).select("s", "p", "o")


def relations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The store's relations by predicate or class, each a scan of its own partition."""
    df = spark.read.schema("s string, o string, p string, class string").parquet(path)
    out: dict[str, DataFrame] = {}
    for p, cls in df.select("p", "class").distinct().collect():  # a vocabulary, from the names of folders
        if p == TYPE:
            out[cls] = df.where((F.col("p") == p) & (F.col("class") == cls)).select("s")
        else:
            out[p] = df.where(F.col("p") == p).select("s", "o")
    return out
