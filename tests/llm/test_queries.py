"""The registered digests: their columns, and those with SQL against it."""

import pytest

from ruleweave.llm import queries

from ..compare import SF, needs_tables, same

COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_decontaminate": "doc_id item_id",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_near_dedup": "doc_id n_shingles component_id kept",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}
KINDS = {"boolean": "over_limit base_failed kept held_out", "double": "score target", "int": "predicted shard grown_shard", "string": "payload_digest record_type base_sha256 spans lang_pred law"}


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split():
        want = next((k for k, names in KINDS.items() if c in names.split()), "bigint")
        assert kinds[c] == want, c
    if name != "op2_decontaminate":
        table = "pages" if name == "op1_warc" else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])
