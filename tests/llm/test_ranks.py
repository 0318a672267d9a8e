"""Prefix doubling with sorted ranks against brute force, and against the query's operator on a whole table."""

import pytest

from tessel.llm import suffix_dedup, suffix_ranks

from .helpers import awkward, corpus, docs
from .test_dedup import brute_bytes


@pytest.mark.parametrize("seed", [5])
def test_ranks_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed, n=40, copies=15) + [(900, "ab" * 200), (901, "ba" * 90), (902, "é" * 70), (903, "é" * 40 + "x"), (904, None), (905, "z" * 49), (906, "z" * 49), (907, "z" * 50), (908, "z" * 51)]
    monkeypatch.setattr(suffix_ranks, "PIECE", 37)
    found = suffix_ranks.cut_by_ranks(docs(spark, rows)).collect()
    assert sorted((r.row.doc_id, len(r.spans), r.kept) for r in found) == brute_bytes(rows)


def facts(df):
    return sorted((r.row.doc_id or -1, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect())


def test_both_forms_agree(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert facts(suffix_ranks.cut_by_ranks(table)) == facts(suffix_dedup.cut_repeated_bytes(table))


def test_awkward_rows(spark):
    t = "a text of more than fifty bytes that two rows with one id have"
    found = suffix_ranks.cut_by_ranks(docs(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    assert sorted((r.row.doc_id or 99, len(r.kept)) for r in found) == [(1, len(t)), (1, len(t)), (2, 0), (99, 0)]
    rows = awkward(spark)
    assert facts(suffix_ranks.cut_by_ranks(rows)) == facts(suffix_dedup.cut_repeated_bytes(rows))
    assert suffix_ranks.cut_by_ranks(rows.limit(0)).count() == 0
