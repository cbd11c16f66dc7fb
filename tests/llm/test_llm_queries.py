"""The registered corpus queries on the smallest driver tables: columns, and contract where SQL can't say it."""

from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")

from ledgerproof.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")
COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_quality_gam": "doc_id held_out score predicted",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_url_rules": "page_id host path rule verdict",
    "op7_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_token_file": "doc_id start n_tokens ids_crc32",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_spelling": "word form root n n_near form_n",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_html_text": "page_id url text n_chars",
}
# What the rows of a result stand for.
ROWS = {"op6_url_rules": ("pages", "page_id"), "op11_spelling": None, "op12_conversation_repair": ("conversations", "conv_id"), "op13_html_text": ("pages", "page_id")}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    if rows := ROWS.get(name, ("documents", "doc_id")):
        table, key = rows
        assert out.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count()
    else:
        assert out.count() > 0
