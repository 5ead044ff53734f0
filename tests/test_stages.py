"""Write-once outputs, resumable appends and phase reuse."""
import os

import pytest
from pyspark.sql import functions as F

from blocklens.plans.stages import StageStore
from blocklens.sources.sinks import append_resumable, write_once


def test_write_once_refuses(spark, tmp_dir):
    df = spark.range(3)
    p = os.path.join(tmp_dir, "ids")
    write_once(df, p)
    with pytest.raises(FileExistsError):
        write_once(df, p)
    # refused when a sibling output exists too
    with pytest.raises(FileExistsError):
        write_once(df, os.path.join(tmp_dir, "other"), p)


def test_append_resumes(spark, tmp_dir):
    todo = spark.createDataFrame([(f"b{i}",) for i in range(10)], "block_id string")
    out = os.path.join(tmp_dir, "preds")
    seen = []

    def compute(rem):
        seen.append(rem.count())
        return rem.withColumn("v", F.lit(1))

    append_resumable(spark, todo.limit(4), out, compute)
    final = append_resumable(spark, todo, out, compute)
    assert seen == [4, 6]
    assert final.count() == 10 and final.select("block_id").distinct().count() == 10


def test_stage_is_reused(spark, tmp_dir):
    store = StageStore(spark, tmp_dir)
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert store.materialize("s", build).count() == 5
    assert store.materialize("s", build).count() == 5
    assert calls == [1] and store.exists("s")


def test_aborted_run_keeps_finished_chunks(spark, tmp_dir):
    todo = spark.createDataFrame([(f"b{i}",) for i in range(40)], "block_id string")
    out = os.path.join(tmp_dir, "chunked")
    state = {"calls": 0}

    def flaky(rem):
        state["calls"] += 1
        if state["calls"] == 3:
            raise RuntimeError("model server went away")
        return rem.withColumn("v", F.lit(1))

    with pytest.raises(RuntimeError):
        append_resumable(spark, todo, out, flaky, chunks=4)
    kept = spark.read.parquet(out).count()
    assert 0 < kept < 40
    final = append_resumable(spark, todo, out, lambda r: r.withColumn("v", F.lit(1)), chunks=4)
    assert final.count() == 40 and final.select("block_id").distinct().count() == 40


def test_figures_are_observed_by_the_pass_that_writes(spark, tmp_dir):
    from pyspark.sql import functions as F

    from blocklens.plans.stages import StageStore
    built = []

    def build():
        built.append(1)
        return spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    store = StageStore(spark, tmp_dir)
    figures = [F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("n_odd")]
    for _ in range(2):
        rows, row = store.observed("numbers", build, figures)
        assert rows.count() == 100 and row.first().asDict() == {"n": 100, "n_odd": 50}
    assert len(built) == 1
    # a run that died before the figures were written starts over
    (store_two := StageStore(spark, tmp_dir + "/two")).materialize("numbers", build)
    assert store_two.observed("numbers", build, figures)[1].first()["n_odd"] == 50 and len(built) == 3
