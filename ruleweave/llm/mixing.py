"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source is expected ``target / source size`` times. The
expected copies are prefix-summed along the source, one random offset is added,
and the document is emitted once for each integer boundary that its step crosses.
All steps of a source are equal, so the prefix sum is rank times step, and ranks
are dealt out cell by cell (:func:`common.spread_rank`): no task gets a whole
source. Documents lie in order of their size's leading digits, so the words
taken stay near the target whatever the spread of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, spread_rank, text_or_empty, word_count

#: Fixed values of the production mix: weights by rank of the source, share of all words, most copies of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def _by_hash(text: Column, digits: int) -> Column:
    return F.substring(F.md5(text), 1, digits)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): targets stop at ``most`` times the source's size.

    The excess over a stop is shared again by weight until no target is above;
    each round is one aggregate of one row over the table of sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    ranked = spread_rank(sources, [], ["part"], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("stop")), "weights")

    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal, level, stopped = total * share, 0.0, -1
    while True:
        at_stop = F.col("stop") < F.col("weight") * level
        now = ranked.agg(
            F.count(F.when(at_stop, 1)),
            F.coalesce(F.sum(F.when(at_stop, F.col("stop"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_stop, F.col("weight"))), F.lit(0.0)),
        ).first()
        if now[0] == stopped or not now[2]:
            break
        stopped, rest, by = now[0], goal - now[1], now[2]
        level = rest / by
    if stopped < 0:  # no sources
        rest, by = 0.0, 1.0
    shared = F.col("weight") * F.lit(rest) / F.lit(by)
    return ranked.select("source", "source_size", F.when(F.col("stop") < F.col("weight") * level, F.col("stop")).otherwise(shared).alias("target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """Rows (row, size, source_size, target, copies): ``row`` is the input row (its columns ``carry``), ``copies`` how often the mix emits it.

    Words are counted once: the rows are written with their sizes before they are ranked.

    A null text has no words; a null source is a source of its own, last in
    order. A source without words has target 0 and no copies. A null doc_id is
    ordered as an empty one. Repeated rows are documents of their own. An empty
    table gives an empty result. Columns of any name pass through inside ``row``.
    """
    size = word_count(text_or_empty())
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"), size.alias("size"))
    rows = saved(rows, "sized")
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    digits = F.length(F.col("size").cast("string"))
    lead = digits * 100 + F.rpad(F.substring(F.col("size").cast("string"), 1, 2), 2, "0").cast("int")
    salt = _by_hash(F.coalesce(F.col("id").cast("string"), F.lit("")), 2)
    ranked = spread_rank(rows.withColumn("lead", lead).withColumn("salt", salt), ["source"], ["lead", "salt"], [F.col("size"), F.col("id")], "rank")
    offset = F.conv(_by_hash(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("null source"))), 8), 16, 10).cast("double") / 4294967296.0
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("rank") + 1) * step + offset) - F.floor(F.col("rank") * step + offset)
    t = targets.withColumnRenamed("source", "of")
    joined = ranked.join(t, ranked.source.eqNullSafe(t.of))
    return joined.select("row", "size", "source_size", "target", F.least(crossed, F.lit(int(-(-most // 1)))).cast("long").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    out = with_copies(docs, **parameters).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
