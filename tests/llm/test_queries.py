"""The registered queries on the tables of a scale factor, against their SQL."""

import os

import pytest

import __spark_entry__ as E
from harness import compare, duck
from ledgerlens.llm.oracle import LLM_ORACLE
from ledgerlens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

ROWS = {"op4_url_filter": "pages", "op10_quote_links": "conversations"}
FIRST_COLUMNS = {
    "op1_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op3_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def test_registered():
    assert set(LLM_QUERIES) | {"pipeline"} <= set(E.queries()) and set(LLM_ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_equals_sql(spark, name):
    r = compare(LLM_QUERIES[name](spark, SF), duck(SF), LLM_ORACLE[name])
    assert r["values_match"], r


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLE)))
def test_one_row_per_row(spark, name):
    df = LLM_QUERIES[name](spark, SF)
    table = spark.read.parquet(f"{SF}/{ROWS.get(name, 'documents')}.parquet")
    assert df.columns[:len(FIRST_COLUMNS.get(name, []))] == FIRST_COLUMNS.get(name, [])
    assert df.count() == table.count()
