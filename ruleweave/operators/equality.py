"""owl:sameAs by components: one representative for each class of equal nodes, pairs only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def representatives(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, rep) for pairs (s, o) of equal nodes: the least node of each connected component.

    Large-star and small-star steps in turn: minima by key, summed up before the
    shuffle, until nothing changes.
    """
    e = pairs.select(F.greatest("s", "o").alias("u"), F.least("s", "o").alias("v")).where("u != v").distinct()
    e = saved(e, "pairs")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "pairs")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            low = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("rep"))
            return low.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("rep")).distinct())
        last = now
    raise RuntimeError(f"equality did not settle in {max_rounds} rounds")


def same_as_pairs(reps: DataFrame) -> DataFrame:
    """All pairs (s, o) of different equal nodes; quadratic in a class, so only for reading."""
    other = reps.select(F.col("node").alias("o"), "rep")
    return reps.join(other, "rep").where("node != o").select(F.col("node").alias("s"), "o")


def rewritten(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """Facts (s) or (s, o) with every node replaced by its representative."""
    names = facts.columns
    for c in names:
        r = reps.select(F.col("node").alias(c), F.col("rep").alias("_rep"))
        facts = facts.join(r, c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    return facts.select(*names).distinct()


def functional_pairs(facts: DataFrame, inverse: bool = False) -> DataFrame:
    """Equal nodes by a functional property: all objects of a subject equal its least one (subjects of an object, if inverse)."""
    key, node = ("o", "s") if inverse else ("s", "o")
    least = facts.groupBy(key).agg(F.min(node).alias("_least"), F.max(node).alias("_most")).where("_least != _most")
    return facts.join(least, key).where(F.col(node) != F.col("_least")).select(F.col(node).alias("s"), F.col("_least").alias("o")).distinct()
