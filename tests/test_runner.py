"""The end-to-end job: phases, reuse, write-once split, resume, metrics-only."""
import os

import pytest
from pyspark.sql import functions as F

from blocklens.plans.runner import DetectionRun
from blocklens.sources import fixtures
from tests.conftest import SF_SMALL


def test_full_run_and_restart(spark, tmp_dir):
    out = os.path.join(tmp_dir, "run")
    lines = fixtures.log_lines(spark, SF_SMALL)
    labels = fixtures.block_labels(spark, SF_SMALL)
    calls = []

    def backend(prompt, temperature):
        calls.append(temperature)
        bad = prompt.contains("<EXCEPTION_DETAIL>")
        return F.when(bad, F.lit('{"classification":"ANOMALY","confidence":0.9}')).otherwise(
            F.lit('{"classification":"NORMAL","confidence":"10%"}'))

    run = DetectionRun(spark, out, backend=backend, sample_size=50)
    res = run.run(lines, labels)
    m = {r["approach"]: r for r in res["metrics_full"].collect()}
    assert m["random_forest"]["f1"] > 0.9
    sm = {r["approach"]: r for r in res["metrics_sample"].collect()}
    assert sm["llm"]["n_total"] == 50 and sm["isolation_forest"]["n_total"] == 50
    for name in ("parsed", "templates", "block_sequences", "split_ids", "features",
                 "predictions_isolation_forest", "predictions_random_forest",
                 "predictions_llm", "alerts_random_forest", "metrics_full"):
        assert os.path.exists(os.path.join(out, name)), name
    assert calls
    split_before = spark.read.parquet(os.path.join(out, "split_ids")).collect()

    # restart: nothing is recomputed, the text model is not called again
    stored = {n: spark.read.parquet(os.path.join(out, n)).collect() for n in (
        "predictions_isolation_forest", "predictions_random_forest")}
    run2 = DetectionRun(spark, out, backend=backend, sample_size=50)
    run2.run(lines, labels)
    for n, rows in stored.items():
        assert sorted(spark.read.parquet(os.path.join(out, n)).collect()) == sorted(rows)
    assert spark.read.parquet(os.path.join(out, "split_ids")).collect() == split_before
    assert spark.read.parquet(os.path.join(out, "predictions_llm")).count() == 50

    # metrics only, from stored predictions
    again = DetectionRun(spark, out).run(None, None, only_metrics=True)
    assert {r["approach"] for r in again["metrics_full"].collect()} == \
        {"isolation_forest", "random_forest"}
    alerts = spark.read.json(os.path.join(out, "alerts_isolation_forest"))
    assert set(alerts.columns) >= {"block_id", "classification", "score", "model", "events",
                                   "severity"}


def test_cli_demo_run(spark, tmp_dir, capsys):
    from blocklens.plans.runner import main
    out = os.path.join(tmp_dir, "cli")
    main(["--demo-sf", SF_SMALL, "--out", out, "--skip-llm", "--miner", "mask"])
    printed = capsys.readouterr().out
    assert "metrics_full" in printed
    assert os.path.exists(os.path.join(out, "predictions_random_forest", "_SUCCESS"))


def test_a_phase_without_its_backend_is_an_error(spark, tmp_dir):
    with pytest.raises(ValueError, match="backend"):
        DetectionRun(spark, os.path.join(tmp_dir, "x")).text_model(None, None, None)


@pytest.mark.parametrize("left", ["split_ids", "predictions_random_forest_draft",
                                  "predictions_random_forest", "rf_model", "iforest_model"])
def test_what_a_dead_write_leaves_does_not_block_a_restart(spark, tmp_dir, left):
    """A folder without its marker is rebuilt; complete stages stay."""
    from blocklens.plans.stages import StageStore, is_complete
    store = StageStore(spark, os.path.join(tmp_dir, "run"))
    os.makedirs(store.path(left))
    open(os.path.join(store.path(left), "part-00000-torn.parquet"), "w").close()
    rows = spark.range(5).toDF("block_id")
    if left == "split_ids":
        assert store.write_once(left, rows).count() == 5
        with pytest.raises(FileExistsError):
            store.write_once(left, rows)
    elif left.startswith("predictions"):
        got = store.timed("predictions_random_forest", lambda: rows)
        assert got.count() == 5 and got.where("inference_time_sec > 0").count() == 5
        assert is_complete(spark, store.path("predictions_random_forest"))
    else:
        from blocklens.operators import forest, iforest
        from pyspark.ml.linalg import Vectors
        vec = spark.createDataFrame(
            [(f"b{i}", "train", "Anomaly" if i % 5 == 0 else "Normal",
              Vectors.sparse(3, {0: float(i % 5 == 0), 2: float(i % 3)})) for i in range(40)],
            ["block_id", "split", "label", "features"])
        if left == "rf_model":
            a, b = (forest.stored_forest(store, left, vec) for _ in range(2))
            assert a.featureImportances == b.featureImportances and a.getNumTrees == 100
        else:
            (n1, p1), (n2, p2) = (iforest.stored_isolation_forest(store, left, vec) for _ in range(2))
            assert p1 == p2 == 32 and n1.count() == n2.count()
