import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside: they must not clash
    T.StructField("fp", T.LongType()), T.StructField("part", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("length", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns."""
    def make(rows, lang="en"):
        full = []
        for r in rows:
            doc_id, text = r[0], r[1]
            full.append((doc_id, text, r[2] if len(r) > 2 else lang, None,
                         None if text is None else len(text), 7, "x", None, "k", "l", None))
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: nulls in any column, empty texts, blanks alone, ties, repeated rows, non-ASCII, a very long text
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Same text."), (5, "Same text."), (6, "Same text."),
       (6, "Same text."), (None, "Same text."), (None, None), (7, "Ünïcödé ß — 日本語 🙂 Σίσυφος"),
       (8, "one two"), (9, "one two three four five six seven. " * 4000), (10, "x" * 5000)]
