import numpy as np
import pandas as pd

from blocklens.llm import language_id as li
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def brute_bundle(text, d):
    """Bundle of one text by the definition, letter by letter."""
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    runs = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    codes = [0 if c == " " else ord(c) for c in runs]
    total = np.zeros(d, np.int64)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b == 0 and (a == 0 or c == 0):
            continue
        total += (np.roll(li.letter_vector(a, d), 2).astype(int) * np.roll(li.letter_vector(b, d), 1)
                  * li.letter_vector(c, d))
    return total


def test_bundles_match_the_definition():
    texts = ["Ab c", "", "...", "x", "Zwölf Boxkämpfer jagen", "日本 語", "a  b\n\tc--d", "the the"]
    got = li.bundles(texts, 64)
    for text, bundle in zip(texts, got):
        assert (bundle == brute_bundle(text, 64)).all(), text


def test_wide_alphabets_are_numbered_by_sorting():
    text = "".join(chr(0x4E00 + i) for i in range(400))
    assert (li.bundles([text], 32)[0] == brute_bundle(text, 32)).all()


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and 200 < len(held) < 500
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    import zlib
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_predictions_ignore_the_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1,
                                           F.lit("xx")).otherwise(F.col("lang")))
    a, b = (li.identify(d).orderBy("doc_id").toPandas() for d in (docs, other))
    pd.testing.assert_frame_equal(a, b)


def test_odd_rows(make_docs):
    got = li.identify(make_docs(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert [r.held_out for r in got if r.doc_id is None] == [None, None]


def test_no_training_rows_and_empty_table(make_docs):
    docs = make_docs([(1, "some words", None)], None)
    assert [r.lang_pred for r in li.identify(docs).collect()] == ["und"]
    assert li.identify(make_docs([])).count() == 0
    assert li.keep_identified(make_docs([])).count() == 0


def test_passes_over_many_languages_agree_with_one(make_docs, monkeypatch):
    rows = [(i, f"{w} {w[::-1]} {w}" * 5, f"l{i % 5}") for i, w in enumerate(
        ["alpha", "quick", "zebra", "öl", "ñandú"] * 6)]
    one = li.identify(make_docs(rows)).orderBy("doc_id").toPandas()
    monkeypatch.setattr(li, "LANGUAGES_PER_PASS", 2)
    two = li.identify(make_docs(rows)).orderBy("doc_id").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_keep_identified_keeps_columns_and_drops_letterless(make_docs):
    rows = [(i, "the words of this text are plain and the rest is too", "en") for i in range(20)]
    docs = make_docs(rows + [(50, "123 456 !!", "en"), (51, None, "en")])
    out = li.keep_identified(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(20))
