"""One key holding a third of all rows: results stay whole and exact."""
from pyspark.sql import functions as F

from blocklens.operators.sampling import stratified_split
from blocklens.operators.sequences import block_sequences, text_sequences
from blocklens.sources.labels import labels_lookup


def _hot_lines(spark, n=30000):
    # block 'hot' gets every third line, the rest spread over 2,000 blocks
    df = spark.range(1, n + 1).select(
        F.col("id").alias("line_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("b"), (F.col("id") % 2000).cast("string"))).alias("block_id"),
        (F.col("id") % 7).cast("int").alias("event_id"))
    return df.repartition(16)


def test_hot_block_sequence_is_whole_and_ordered(spark):
    seqs = block_sequences(_hot_lines(spark), chunk_bits=10)
    hot = seqs.where("block_id = 'hot'").first()
    assert hot["sequence_length"] == 10000
    assert hot["events"] == [(3 * k) % 7 for k in range(1, 10001)]
    assert seqs.agg(F.sum("sequence_length")).first()[0] == 30000


def test_hot_block_text(spark):
    seqs = block_sequences(_hot_lines(spark, 3000), chunk_bits=6)
    tpl = spark.createDataFrame([(i, f"t{i}") for i in range(7)],
                                "event_id int, event_template string")
    txt = text_sequences(seqs.where("block_id = 'hot'"), tpl).first()["text_sequence"]
    lines = txt.split("\n")
    assert len(lines) == 1000
    assert lines[0] == "Event 1: t3" and lines[-1] == f"Event 1000: t{3000 % 7}"


def test_hot_label_key(spark):
    rows = _hot_lines(spark).select(
        "block_id", F.when(F.col("event_id") == 0, "Anomaly").otherwise("Normal").alias("label"),
        F.col("line_id").alias("row_order"))
    got = {r[0]: r[1] for r in labels_lookup(rows, "row_order").collect()}
    # the last 'hot' row is line 30000: 30000 % 7 = 5 -> Normal
    assert got["hot"] == "Normal" and len(got) == 2001


def test_dominant_class_split_exact(spark):
    ids = spark.range(60000).select(
        F.concat(F.lit("blk_"), F.col("id").cast("string")).alias("block_id"),
        F.when(F.col("id") % 50 == 0, "Anomaly").otherwise("Normal").alias("label"))
    s = stratified_split(ids)
    got = {(r[0], r[1]): r[2] for r in s.groupBy("split", "label").count().collect()}
    assert got[("test", "Anomaly")] == 240 and got[("test", "Normal")] == 11760
