"""The registered queries of this package, thin digests of each operator's result, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .decontaminate import contaminated
from .language_id import identify
from .mixing import with_copies
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality_classifier import quality
from .quality_rules import quality_rules
from .sharding import shard
from .token_counts import token_counts
from .warc import read_archives, write_archives


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ruleweave/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path, payload=False).where("gap is null")

    def page(urn: str):
        return F.nullif(F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes, d.payload_digest,
  CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 1000""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
k AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM n, unnest([0, 1, 2]) AS t(j) GROUP BY r),
l AS (SELECT r, host, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM d),
o AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT r) > 50),
m AS (SELECT l.r, sum(len(string_split(l.line, ' '))) AS removed_words FROM l JOIN o ON o.host = l.host AND o.line = l.line GROUP BY l.r),
x AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls, coalesce(k.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(m.removed_words, 0)::BIGINT AS removed_words FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN m ON m.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 50 * n_words AS kept FROM x""",
    "op7_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS stop FROM s),
t AS (SELECT coalesce(sum(source_size), 0) * 1.5::DOUBLE AS goal FROM w),
u AS (SELECT 0 AS turn, goal AS rest, (SELECT sum(weight) FROM w) AS by_ FROM t
  UNION ALL SELECT * FROM (SELECT u.turn + 1, max(t.goal) - coalesce(sum(w.stop) FILTER (w.stop < w.weight * (u.rest / u.by_)), 0) AS rest, sum(w.weight) FILTER (NOT w.stop < w.weight * (u.rest / u.by_)) AS by_ FROM u, t, w WHERE u.turn < 60 GROUP BY u.turn) WHERE by_ IS NOT NULL),
v AS (SELECT rest, by_ FROM u ORDER BY turn DESC LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN stop < weight * (rest / by_) THEN stop ELSE weight * rest / by_ END AS target FROM w, v),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(size::VARCHAR) * 100 + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, doc_id) - 1 AS rank FROM d),
e AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.rank, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS step,
  ('0x' || substr(md5('mix-1:' || coalesce(r.source, 'null source')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS offset_ FROM r JOIN g ON g.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (least(floor((rank + 1) * step + offset_) - floor(rank * step + offset_), 2)::BIGINT * size)::BIGINT AS taken FROM e""",
}
