"""Stages of the pipeline on tables whose extra columns have the names that the stages use themselves."""

from collections import Counter

import pytest

from tests.conftest import SMALL

NAMES = ["_score", "_null", "_id", "_text", "row", "root", "check", "digest", "kept", "score", "n_removed", "doc", "gone", "packed", "item_id"]


@pytest.mark.parametrize("name", ["quality", "near_copies", "repeats", "leaks"])
def test_clashing_names_pass_through(spark, some_docs, name):
    import corpus_pipeline

    docs = some_docs.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *(f"concat('{c}', doc_id) AS {c}" for c in NAMES))
    plain = dict(corpus_pipeline.STAGES)[name](spark, some_docs.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars"), SMALL)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES)
