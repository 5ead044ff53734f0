"""Properties: quota arithmetic, counts vs lengths, ranks are permutations."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blocklens.operators.features import block_event_counts
from blocklens.operators.sampling import approximate_mode, rank_in_class
from blocklens.operators.sequences import block_events, block_sequences
from blocklens.plans.context import LogContext
from tests.conftest import SF_SMALL


@settings(max_examples=25, deadline=None)
@given(counts=st.lists(st.integers(min_value=1, max_value=10_000), min_size=1, max_size=6),
       frac=st.floats(min_value=0.0, max_value=1.0))
def test_quotas_sum_and_stay_close(spark, counts, frac):
    total = sum(counts)
    draws = int(frac * total)
    df = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(counts)],
                               "label string, n_c long")
    q = {r["label"]: r["quota"] for r in
         approximate_mode(df, F.lit(draws), "label").collect()}
    assert sum(q.values()) == draws
    for i, n in enumerate(counts):
        exact = draws * n / total
        assert abs(q[f"c{i}"] - exact) < 1 + 1e-9
        assert 0 <= q[f"c{i}"] <= n


def test_counts_sum_to_sequence_length(spark):
    ctx = LogContext.of(spark, SF_SMALL)
    seqs = block_sequences(ctx.assigned)
    counts = block_event_counts(block_events(ctx.assigned)).groupBy("block_id") \
        .agg(F.sum("n").alias("total"))
    bad = seqs.join(counts, "block_id", "full").where(
        F.col("total").isNull() | F.col("sequence_length").isNull() |
        (F.col("total") != F.col("sequence_length")))
    assert bad.count() == 0


def test_class_ranks_are_dense(spark):
    ids = spark.range(5000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("block_id"),
        F.when(F.col("id") % 9 == 0, "A").otherwise("B").alias("label"))
    r = rank_in_class(ids, "label")
    per = r.groupBy("label").agg(F.min("class_rank").alias("lo"), F.max("class_rank").alias("hi"),
                                 F.count("*").alias("n"), F.countDistinct("class_rank").alias("d"))
    for row in per.collect():
        assert row["lo"] == 1 and row["hi"] == row["n"] == row["d"]
