"""The queries with SQL against their twins on the smallest tables, and those without on their columns."""

from __future__ import annotations

import zlib

import pytest
from compare import check, connection

from runlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op4_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_toxicity": {"doc_id", "score", "predicted"},
    "op8_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op11_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, con, name):
    rows, problem = check(spark, con, Q.QUERIES[name], Q.ORACLES.get(name), SF)
    assert problem is None
    assert COLUMNS[name] <= set(Q.QUERIES[name](spark, SF).columns)
    if name in ("op11_spelling", "op12_prefix_trie"):  # not a row per row of a table
        return
    table = "pages" if name.startswith("op10") else "conversations" if name.startswith("op3") else "documents"
    n = con.execute(f"select count({'distinct conv_id' if table == 'conversations' else '*'}) from {table}").fetchone()[0]
    assert rows == n + (table == "conversations")


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.9), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, con, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.QUERIES[name](spark, sf).collect()}
    want = dict(connection(sf).execute(f"select doc_id, {label} from labels").fetchall())
    unseen = [d for d in want if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d]["score"] <= 1 for d in got)
    assert sum(got[d]["predicted"] == want[d] for d in unseen) >= least * len(unseen)
