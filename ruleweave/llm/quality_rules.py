"""Quality rules with line frequencies across documents, in DataFrame operations only.

Lines are normalised (lower case, digits as 0, white space as one space) and
hashed. A line that more than ``limit`` documents of one host hold is removed
from its documents; a document that loses more than half of its words is
rejected, besides those that fail the rules on its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty, words

#: Documents of a host that may hold a line.
LIMIT = 50
#: Percent of a document's words that may be removed.
DEPLETED = 50
_SYMBOLS = "#*$%&|<>"


def _repeated(words: Column, n: Column) -> tuple[Column, Column]:
    """3-word windows as (hash, place), sorted; the places of those that occur twice or more."""
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
    )
    return F.sort_array(windows), n


def own_metrics(docs: DataFrame) -> DataFrame:
    """Each row's own counts; other columns of ``docs`` but text pass through."""
    rest = [c for c in docs.columns if c != "text"]
    text = text_or_empty()
    rows = docs.select(*rest, text.alias("text")).withColumn("w", words(F.col("text")))
    rows = rows.withColumn("n", F.size("w"))
    windows, _ = _repeated(F.col("w"), F.col("n"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *rest,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{_SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("s"),
    )
    twice = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each place covers three words, or as far as the next place
    steps = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.coalesce(F.size("at"), F.lit(0)) > 0, F.aggregate(steps, F.lit(3), lambda n, x: n + x)).otherwise(0)
    rows = rows.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _every_line(text: Column) -> Column:
    # only white space that isn't one plain space already is replaced, as most is
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))


def normalised_lines(text: Column) -> Column:
    """The lines of a text, normalised; lines without a word are left out."""
    return F.filter(_every_line(text), lambda x: x != "")


def _host() -> Column:
    """The host of a row as a key that is never null; a null source is none that a text can name."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def _judged(docs: DataFrame, limit: int, depleted: int, row: Column | None = None) -> DataFrame:
    """The counts and the verdict of each row; if its ``row`` is given, that too, and the hashes of its removed lines as ``gone``."""
    text = text_or_empty()
    keys = [
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _host()).alias("k2"),
    ]
    carried = [] if row is None else ["row"]
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), text.alias("text"), *([] if row is None else [row.alias("row")]))
    docs = docs.select("doc_id", "source", "text", *carried, *keys)
    host = _host().alias("host")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    hashed = F.transform(normalised_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), (spaces(x) + 1).alias("words")))
    lines = saved(docs.select("k1", "k2", host, hashed.alias("lines")), "lines")  # texts are cut to lines once
    held = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > limit)
    often = saved(often.select(F.col("host").alias("h"), F.col("line").alias("l")), "often")  # once written, Spark knows its size and picks the join by it
    each = lines.select("k1", "k2", "host", F.explode("lines").alias("x")).select("k1", "k2", "host", "x.line", "x.words")
    removed = each.join(often, (F.col("host") == F.col("h")) & (F.col("line") == F.col("l")), "left_semi")
    removed = removed.groupBy("k1", "k2").agg(F.sum("words").alias("sum"), *([] if row is None else [F.collect_set("line").alias("gone")]))
    own = own_metrics(docs.drop("source"))
    # rows that are equal in all that is read share a key: the sum is theirs together
    copies = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    removed = removed.join(copies, ["k1", "k2"]).select("k1", "k2", *([] if row is None else ["gone"]), (F.col("sum") / F.col("copies")).cast("long").alias("removed_words"))
    removed = saved(removed, "removed")
    out = own.join(removed, ["k1", "k2"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    kept = ~F.col("base_failed") & (100 * F.col("removed_words") <= depleted * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", kept.alias("kept"), *carried, *([] if row is None else ["gone"]))


def quality_rules(docs: DataFrame, limit: int = LIMIT, depleted: int = DEPLETED) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, removed_words and kept.

    This is the digest of :func:`without_frequent_lines`: both have their verdict
    from the same removed lines. ``source`` names the host; a null source is a host
    of its own. A null text has no words and fails. Repeated rows count as a document
    each. A null doc_id is a value like any. An empty table gives an empty result;
    other columns are not read.
    """
    return _judged(docs, limit, depleted)


def without_frequent_lines(docs: DataFrame, limit: int = LIMIT, depleted: int = DEPLETED) -> DataFrame:
    """The rows of ``docs`` with the text of their lines that are not over the limit, and removed_words and kept.

    All rows are there, those that are rejected with ``kept`` false. Other lines and
    those without a word stay as they are; a null text stays null. Columns of
    ``docs`` named removed_words or kept are replaced.
    """
    rows = _judged(docs, limit, depleted, F.struct("*"))
    text = F.col("row")["text"]
    pairs = F.arrays_zip(F.split(text, "\n").alias("raw"), _every_line(text).alias("line"))
    stays = F.filter(pairs, lambda x: (x["line"] == "") | ~F.array_contains("gone", F.xxhash64(x["line"])))
    rebuilt = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stays, lambda x: x["raw"]), "\n"))
    columns = [rebuilt.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("removed_words", "kept")]
    return rows.select(*columns, "removed_words", "kept")
