"""Sequences, vocabulary and count features on a hand-made line table."""
from pyspark.sql import functions as F

from blocklens.functions.text import event_chain
from blocklens.operators.features import (block_event_counts, count_matrix_long,
                                          count_matrix_wide, train_vocabulary)
from blocklens.operators.sequences import block_events, block_sequences


def _lines(spark):
    rows = [(1, "a", 1), (2, "b", 2), (3, "a", 10), (4, "a", 1), (5, "b", 2)]
    return spark.createDataFrame(rows, "line_id long, block_id string, event_id int")


def test_sequence_order_and_length(spark):
    s = {r["block_id"]: r for r in block_sequences(_lines(spark)).collect()}
    assert s["a"]["events"] == [1, 10, 1] and s["a"]["sequence_length"] == 3
    assert s["b"]["events"] == [2, 2]


def test_sequence_order_across_chunks(spark):
    """Pieces of one block in different line-range chunks are concatenated in order."""
    rows = [(i * 7, "hot", i % 5) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "line_id long, block_id string, event_id int").repartition(7)
    got = block_sequences(df, chunk_bits=8).first()
    assert got["events"] == [i % 5 for i in range(1, 3001)]


def test_vocabulary_and_counts(spark):
    ev = block_event_counts(block_events(_lines(spark)))
    split = spark.createDataFrame([("a", "Normal", "train"), ("b", "Normal", "test")],
                                  "block_id string, label string, split string")
    vocab = train_vocabulary(ev, split)
    assert [(r[0], r[2]) for r in vocab.orderBy("feature_index").collect()] == \
        [(1, "E1"), (2, "E10")]
    long_c = count_matrix_long(ev, split, vocab)
    wide = {r["block_id"]: r.asDict() for r in
            count_matrix_wide(long_c, split, ["E1", "E10"]).collect()}
    assert wide["a"]["E1"] == 2 and wide["a"]["E10"] == 1
    assert wide["b"]["E1"] == 0 and wide["b"]["E10"] == 0


def test_string_order_vocabulary(spark):
    rows = [(1, "a", 1), (2, "a", 10), (3, "a", 2)]
    ev = spark.createDataFrame(rows, "line_id long, block_id string, event_id int")
    split = spark.createDataFrame([("a", "Normal", "train")], "block_id string, label string, "
                                  "split string")
    names = [r[0] for r in train_vocabulary(ev, split).orderBy("feature_index")
             .select("feature_name").collect()]
    assert names == ["E1", "E10", "E2"]


def test_event_chain(spark):
    df = spark.createDataFrame([(list(range(1, 18)),), ([3, 4],)], "events array<int>")
    got = [r[0] for r in df.select(event_chain(F.col("events"))).collect()]
    assert got[0].startswith("E1 → E2") and got[0].endswith("E15 → ... (+2 more)")
    assert got[1] == "E3 → E4"


def test_dense_ordinal_on_fresh_aggregate(spark):
    """Ordinals over a recomputed aggregate equal a plain global row_number."""
    from pyspark.sql import Window

    from blocklens.operators.ordinals import dense_ordinal
    base = spark.range(0, 20000).select((F.col("id") * 7919 % 10007).alias("k"))
    agg = base.repartition(13).groupBy("k").agg(F.count("*").alias("c"))
    got = {r["k"]: r["o"] for r in dense_ordinal(agg, ["k"], "o", num_partitions=9).collect()}
    want = {r["k"]: r["o"] for r in agg.select(
        "k", F.row_number().over(Window.orderBy("k")).alias("o")).collect()}
    assert got == want


def test_sequences_independent_of_partitioning(spark):
    rows = [(i, f"b{i % 37}", (i * 13) % 11) for i in range(1, 4001)]
    df = spark.createDataFrame(rows, "line_id long, block_id string, event_id int")
    a = {r["block_id"]: r["events"] for r in block_sequences(df.repartition(1)).collect()}
    b = {r["block_id"]: r["events"] for r in
         block_sequences(df.repartition(17, "event_id"), chunk_bits=5).collect()}
    assert a == b and sum(len(v) for v in a.values()) == 4000
