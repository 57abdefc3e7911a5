"""Every query's columns and types, digests and bounds, and the SQL of those that have it."""

import os
import re

import duckdb
import pytest

from tabulon.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
COLUMNS = {
    "op1_mix_sources": {"doc_id": "bigint", "n_epochs": "bigint"},
    "op2_language_mixture": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_host_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_perplexity": {"doc_id": "bigint", "perplexity": "double", "kept": "boolean"},
    "op10_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}
HEX = {"ids_sha256": 64, "decoded_sha256": 64, "base_sha256": 64, "fingerprint": 16}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_types_and_bounds(spark, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    assert rows
    for r in rows:
        for c, n in HEX.items():
            assert c not in kinds or re.fullmatch(f"[0-9a-f]{{{n}}}", r[c])
        if name in ("op2_language_mixture", "op5_toxicity"):
            assert 0 <= r["score"] <= 1
        if "predicted" in kinds:
            assert r["predicted"] == int(r["score"] >= 0.5)
    if name not in ("op1_mix_sources", "op10_nearest"):
        source = spark.read.parquet(f"{SF}/{'pages' if name == 'op7_main_text' else 'documents'}.parquet")
        assert len(rows) == source.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_the_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_texts_without_a_letter_have_no_language(spark):
    from tabulon.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, "😀😀😀"), (2, "12 𝟘𝟙"), (3, "𐐀𐐁 𐐂"), (4, None), (5, "the weather with that")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, language_id.train(docs)).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] != "und" and got[5][0] == "en"
    assert all(bool(language_id.letters()[i]) == chr(i).isalpha() for i in range(0, 0x110000, 7))
