"""Stages dealt by block id: joins without a shuffle, lookups of one bucket."""
import pytest
from pyspark.sql import functions as F

from blocklens.operators.alerts import generate_alerts
from blocklens.operators.sequences import sequences_labeled
from blocklens.plans.stages import StageStore
from blocklens.sources.sinks import remaining_work


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture()
def stages(spark, tmp_dir):
    store = StageStore(spark, tmp_dir + "/store")
    ids = spark.range(400).select(F.concat(F.lit("blk_"), "id").alias("block_id"), "id")
    return store, {
        "sequences": store.bucketed("sequences", lambda: ids.select(
            "block_id", F.array(F.lit(1), F.lit(2)).alias("events")), buckets=8),
        "labels": store.bucketed("labels", lambda: ids.where("id % 3 > 0").select(
            "block_id", F.lit("Normal").alias("label")), buckets=8),
        "predictions": store.bucketed("predictions", lambda: ids.where("id % 2 = 0").select(
            "block_id", F.lit(-0.2).alias("score"), F.lit("Anomaly").alias("classification"),
            F.lit("Normal").alias("label")), buckets=8)}


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_block_id_need_no_exchange(spark, no_broadcast, stages):
    _, t = stages
    joins = {
        "J1": sequences_labeled(t["sequences"], t["labels"]),
        "J2": t["sequences"].join(t["labels"].select("block_id"), "block_id", "left_semi"),
        "J3": generate_alerts(t["predictions"], "isolation_forest", t["sequences"]),
        "J4": remaining_work(t["sequences"], t["predictions"])}
    counts = {"J1": 400, "J2": 266, "J3": 200, "J4": 200}
    for name, df in joins.items():
        assert "Exchange" not in plan_of(df), name
        assert df.count() == counts[name]


def rows_scanned(df):
    """Rows that the scan of a query over one stage has read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    plans = [p.executedPlan().collectLeaves().apply(0) if "AdaptiveSparkPlan" in p.nodeName() else p for p in plans]
    return sum(p.metrics().apply("numOutputRows").value() for p in plans)


@pytest.fixture()
def buckets_alone(spark):
    """Without the file format's own filters."""
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    yield
    spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_lookup_of_one_block_reads_one_bucket(spark, stages, buckets_alone):
    _, t = stages
    assert rows_scanned(t["sequences"].where("block_id is not null")) == 400
    one = t["sequences"].where(F.col("block_id") == "blk_77")
    assert 0 < rows_scanned(one) < 100 and one.count() == 1
    three = t["sequences"].where(F.col("block_id").isin("blk_1", "blk_2", "blk_3"))
    assert rows_scanned(three) < 250 and three.count() == 3


def test_a_later_session_registers_what_is_there(spark, stages, buckets_alone):
    store, t = stages
    before = sorted(map(tuple, t["labels"].collect()))
    for row in spark.sql("SHOW TABLES").collect():
        if row.tableName.startswith("stage_"):
            spark.sql(f"DROP TABLE {row.tableName}")

    def never():
        raise AssertionError("the stage is there")
    again = StageStore(spark, store.root).bucketed("labels", never, buckets=8)
    assert sorted(map(tuple, again.collect())) == before
    assert 0 < rows_scanned(again.where(F.col("block_id") == "blk_1")) < 80


def test_a_write_that_died_is_written_over(spark, tmp_dir):
    store = StageStore(spark, tmp_dir + "/store")
    spark.range(5).write.parquet(store.path("x_in_4"))
    import os
    os.remove(store.path("x_in_4") + "/_SUCCESS")
    made = store.bucketed("x", lambda: spark.range(9).select(F.col("id").cast("string").alias("block_id")), buckets=4)
    assert made.count() == 9
