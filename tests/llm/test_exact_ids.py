"""Ids above 2**53 beside a null id come through every operator unchanged."""
import pytest

import corpus_pipeline
from blocklens.llm import (bpe, exact_dedup, hmm, language_id, packing, paragraph_dedup, simhash, suffix_dedup,
                           warc, winnowing)

BIG = 2 ** 60
TEXT = "the same words of a text that stands here more than once and is long enough for all. " * 4
ROWS = [(BIG + 1, TEXT), (BIG + 3, TEXT), (BIG + 5, "another text of its own"), (None, "no id at all")]
IDS = {BIG + 1, BIG + 3, BIG + 5, None}


def docs_of(make_docs):
    return make_docs(ROWS).coalesce(1)


def op_rows(word_bpe):
    return {
        "bpe": lambda d: bpe.digest_documents(d, word_bpe), "bpe-ids": lambda d: bpe.encode_documents(d, word_bpe),
        "exact": exact_dedup.exact_dedup, "hmm": lambda d: hmm.score_documents(d, warm_rounds=1, passes=1),
        "language": language_id.identify, "packing": lambda d: packing.pack(d, word_bpe),
        "paragraph": paragraph_dedup.paragraph_dedup, "simhash": simhash.near_duplicates,
        "suffix": suffix_dedup.suffix_dedup, "winnowing": winnowing.winnow_documents}


@pytest.mark.parametrize("name", ["bpe", "bpe-ids", "exact", "hmm", "language", "packing", "paragraph",
                                  "simhash", "suffix", "winnowing"])
def test_ids_stay_as_they_are(make_docs, word_bpe, name):
    got = op_rows(word_bpe)[name](docs_of(make_docs)).collect()
    assert {r.doc_id for r in got} == IDS


def test_one_copy_stays(make_docs):
    for drop in (exact_dedup.drop_copies, simhash.drop_near_duplicates):
        kept = sorted((r.doc_id or 0, r.text) for r in drop(docs_of(make_docs)).collect())
        assert [t for _, t in kept].count(TEXT) == 1 and len(kept) == 3
        assert {i for i, _ in kept} <= {i or 0 for i in IDS}


def test_pages_keep_their_ids(spark):
    pages = spark.createDataFrame(
        [(BIG + 1, "http://a", "x" * 2000), (BIG + 3, "http://b", "x" * 2000), (None, "http://c", None)],
        "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert set(got) == {BIG + 1, BIG + 3, None}
    assert got[BIG + 1].refers_to == BIG + 3 and got[BIG + 3].record_type == "response"


def test_every_pipeline_stage_keeps_them(spark, make_docs):
    docs = docs_of(make_docs)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
        assert {r.doc_id for r in docs.collect()} <= IDS, name
