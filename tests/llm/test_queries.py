"""The registered queries of this package: against SQL on the smallest tables, and their contracts."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from sensorloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_katz_backoff": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_simhash_near_duplicates": "doc_id fingerprint component_id",
    "op4_page_main_text": "page_id url text n_chars",
    "op5_toxicity_pairs": "doc_id held_out score predicted",
    "op6_repeated_passages": "doc_id start_word end_word n_words partner_id identity",
}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_sql(spark, name):
    query, sql = QUERIES[name]
    assert compare(query, sql, spark, FOLDER, connect(FOLDER)) is None


@pytest.mark.parametrize("name", COLUMNS)
def test_query_without_sql_has_its_columns(spark, name):
    rows = QUERIES[name][0](spark, FOLDER)
    assert rows.columns == COLUMNS[name].split()
    table = spark.read.parquet(f"{FOLDER}/{'pages' if name == 'op4_page_main_text' else 'documents'}.parquet")
    if name in ("op1_katz_backoff", "op3_simhash_near_duplicates", "op4_page_main_text", "op5_toxicity_pairs"):
        assert rows.count() == table.count()


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
