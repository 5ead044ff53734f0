"""The corpus pipeline: five stages over ``documents``, each on all that the
one before kept.

    language ID          documents in no known language go
    exact dedup          of equal texts, the largest doc_id stays
    SimHash near-dedup   one document of each group stays
    suffix-array dedup   bytes of 200-byte strings that stand twice are cut
    best-fit packing     what is left is packed into sequences of 2048 tokens

Each stage's result is written as Parquet in the shared folder and read back,
so a lost executor costs no more than tasks of the stage that runs.

Defined results: a null text is in no language and goes with the first stage,
as do texts without a letter; a null doc_id is an id like any other and sorts
below them; rows that share a doc_id are judged one by one, equal rows count as
copies; an empty table leaves every stage empty; further columns of documents
come along until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blocklens.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from blocklens.llm.common import stage
from blocklens.session import ship_package


def _tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: no SQL: hashes, tokens and packing are beyond it (the tests hold the stages
#: against brute force)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: one per packed piece."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
