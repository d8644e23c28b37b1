"""The registered text queries return the agreed columns, one row per document where that is agreed."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

from depotlens.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_sentencepiece": "doc_id n_ids ids_crc32",
    "op6_license_scan": "doc_id path licence",
    "op7_near_dedup": "doc_id class_id",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_simhash": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, documents, name):
    frame = queries.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())


@pytest.fixture(scope="module")
def odd(docs, tmp_path_factory):
    """A folder whose documents are the odd rows, with clashing columns, in files of three partitions."""
    folder = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_on_odd_rows(spark, docs, odd, name):
    rows = queries.queries()[name](spark, odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("rows", ["odd", "whole"])
def test_pieces_hold_every_token_once(spark, documents, odd, rows):
    """Sequences are gapless, and a document's pieces, by their start, cover its tokens."""
    folder = odd if rows == "odd" else SF_DIR
    pieces = queries.op2_packing(spark, folder).collect()
    given = Counter(r.doc_id for r in queries.documents(spark, folder).select("doc_id").collect())
    sequences, tokens, whole = defaultdict(list), Counter(), defaultdict(set)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
        whole[r.doc_id].add(r.doc_tokens)
    assert set(tokens) == set(given)
    for doc_id, held in tokens.items():
        # Rows that share an id are repeated rows here, so their tokens are the same.
        assert len(whole[doc_id]) == 1 and held == given[doc_id] * max(whole[doc_id])
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_phrases_on_odd_rows(spark, odd):
    frame = queries.op11_phrases(spark, odd)
    assert set("lang rank phrase a l r n score".split()) <= set(frame.columns)
    found = {(r.lang, r.phrase): r.a for r in frame.collect()}
    assert all(a >= 10 for a in found.values()) and any("lorem" in phrase for _, phrase in found)


def test_counts_of_personal_data(spark):
    for r in queries.op4_pii(spark, SF_DIR).collect():
        for kind in ("email", "ip", "card", "phone"):
            assert r.spans.count(f"{kind}:") >= r[f"n_{kind}"]
