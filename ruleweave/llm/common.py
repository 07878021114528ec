"""Helpers that several operators share: shared storage, ranks, components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of characters outside ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Let the Python workers of a session started elsewhere import this package.

    A cluster ships the package with ``--py-files``; this covers workers on
    machines that hold the repository at the same path.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let fewer rows go to Python at once than Spark's default, unless the session says how many: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ruleweave-")
        spark.conf.set("spark.checkpoint.dir", at)
        _written.append((spark, at))
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: what is read later survives a lost executor, and nothing
    upstream runs again. The files go when the driver's process ends, by
    :func:`release`, or by :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ruleweave/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`saved` has written; nothing may read them any more."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)
        _written.remove((df.sparkSession, df._saved_at))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds now; it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Delete what :func:`saved` has written in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the folder is then its owner's to clear
            pass


atexit.register(release)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array, natively."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without an array: gaps are cut to one space each, then counted."""
    # only white space that isn't one plain space already is replaced, as most is
    flat = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" ")))
    return F.when(flat == "", 0).otherwise(spaces + 1).cast("long")


def spread_rank(df: DataFrame, group: list[str], bins: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's rank from 0 in its group, by the bins and then by ``order``.

    A group may hold any share of the rows, so no task gets a whole group: each
    cell (group and bins) is ranked alone, and the cells' counts, summed before
    they are shuffled, give each cell its first rank. The bins must cut a group
    into a bounded number of cells.
    """
    cells = df.groupBy(*group, *bins).agg(F.count(F.lit(1)).alias("_cell"))
    before = Window.partitionBy(*group).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_cell").over(before), F.lit(0))).drop("_cell")
    keys = [*group, *bins]
    renamed = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(renamed, on)
        .withColumn(name, F.col("_first") + F.row_number().over(within) - 1)
        .drop("_first", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, label), label the smallest node.

    Alternates large-star and small-star steps, each a minimum by key (summed
    up before the shuffle) and an equi-join whose hot keys Spark can split.
    Every round is written to the shared folder. Nodes without edges are absent.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    e = saved(e, "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, before = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges"), e
        forget(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tidy(e.sparkSession)
        if now == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
