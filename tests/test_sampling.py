"""Exact stratified quotas and hash-ordered membership."""
from pyspark.sql import functions as F

from blocklens.operators.sampling import approximate_mode, stratified_sample, stratified_split


def _quotas(spark, counts, draws_expr):
    df = spark.createDataFrame(list(counts.items()), "label string, n_c long")
    return {r["label"]: r["quota"] for r in
            approximate_mode(df, F.expr(draws_expr), "label").collect()}


def test_published_split_sizes(spark):
    counts = {"Normal": 558223, "Anomaly": 16838}
    train = _quotas(spark, counts, "n_total - ceil(0.2D * n_total)")
    assert train == {"Normal": 446578, "Anomaly": 13470}
    test = {k: counts[k] - v for k, v in train.items()}
    assert test == {"Normal": 111645, "Anomaly": 3368}
    sample = _quotas(spark, test, "least(1000, n_total)")
    assert sample == {"Normal": 971, "Anomaly": 29}


def _ids(spark, n, share):
    rows = [(f"blk_{i}", "Anomaly" if i % share == 0 else "Normal") for i in range(n)]
    return spark.createDataFrame(rows, "block_id string, label string")


def test_split_is_exact_partition(spark):
    ids = _ids(spark, 2000, 25)
    s = stratified_split(ids)
    got = {(r["split"], r["label"]): r["n"] for r in
           s.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    n_test = 400  # ceil(0.2 * 2000)
    assert got[("test", "Normal")] + got[("test", "Anomaly")] == n_test
    assert got[("test", "Anomaly")] == 16 and got[("train", "Anomaly")] == 64
    assert s.count() == 2000 and s.select("block_id").distinct().count() == 2000


def test_independent_of_partitioning(spark):
    ids = _ids(spark, 1500, 10)
    a = {r[0] for r in stratified_sample(ids.repartition(1), size=100).select("block_id")
         .collect()}
    b = {r[0] for r in stratified_sample(ids.repartition(13), size=100).select("block_id")
         .collect()}
    assert a == b and len(a) == 100


def test_matches_plain_window(spark):
    """The bucketed rank equals a plain per-class window ordering."""
    from pyspark.sql import Window
    ids = _ids(spark, 3000, 7)
    got = {r[0] for r in stratified_sample(ids, size=300).select("block_id").collect()}
    h = F.md5(F.concat(F.col("block_id"), F.lit(":42")))
    w = Window.partitionBy("label").orderBy(h, "block_id")
    ranked = ids.withColumn("rk", F.row_number().over(w))
    quota = {"Normal": 257, "Anomaly": 43}
    want = {r["block_id"] for r in ranked.collect() if r["rk"] <= quota[r["label"]]}
    assert got == want
