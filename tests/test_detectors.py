"""Isolation forest and random forest on synthetic count features."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens.operators.forest import (feature_importances, predict_random_forest,
                                        train_random_forest)
from blocklens.operators import iforest
from blocklens.operators.iforest import score_isolation_forest, train_isolation_forest

NAMES = ["E1", "E2", "E3"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        split = "train" if i < 480 else "test"
        anomalous = i % 20 == 0
        coin = lambda: sum(rng.random() < 0.5 for _ in range(20))
        if anomalous:   # far outside the bulk of the Normal rows
            e1, e2, e3 = 30 + rng.randint(0, 3), rng.randint(0, 1), rng.randint(5, 9)
        else:
            e1, e2, e3 = coin(), coin(), 0
        rows.append((f"b{i}", split, "Anomaly" if anomalous else "Normal", e1, e2, e3))
    return spark.createDataFrame(rows, "block_id string, split string, label string, "
                                 "E1 long, E2 long, E3 long")


def test_iforest_outliers_rank_high(spark, wide):
    nodes, psi = train_isolation_forest(spark, wide, NAMES, n_trees=30)
    assert psi == 256
    s = score_isolation_forest(spark, nodes, psi, wide, NAMES, split=None)
    pdf = s.toPandas()
    median = pdf["score"].median()
    planted = pdf[pdf["label"] == "Anomaly"]
    assert (planted["score"] < median).all()          # lower decision = more anomalous
    assert (planted["classification"] == "Anomaly").mean() > 0.9


def test_iforest_deterministic(spark, wide):
    a, _ = train_isolation_forest(spark, wide, NAMES, n_trees=10)
    b, _ = train_isolation_forest(spark, wide.repartition(5), NAMES, n_trees=10)
    key = ["tree_id", "node_id"]
    assert a.orderBy(key).collect() == b.orderBy(key).collect()


def test_iforest_trains_on_normal_only(spark, wide):
    only_anomaly = wide.withColumn("label", F.lit("Anomaly"))
    with pytest.raises(ValueError):
        train_isolation_forest(spark, only_anomaly, NAMES, n_trees=2)


def test_random_forest_separates(spark, wide):
    model = train_random_forest(wide, NAMES, numTrees=20)
    pred = predict_random_forest(model, wide, NAMES).toPandas()
    assert (pred["classification"] == pred["label"]).all()
    top = feature_importances(spark, model, NAMES, top=1).first()
    assert top["feature_name"] in ("E1", "E3")


def test_sparse_vector_form_matches_wide(spark, tmp_dir):
    """Both feature forms give the same counts and the same forest."""
    from blocklens.operators.features import (block_event_counts, count_matrix_long,
                                              count_matrix_wide, sparse_counts, train_vocabulary,
                                              vector_schema)
    from blocklens.operators.sequences import block_events
    from blocklens.plans.stages import StageStore
    rng = random.Random(11)
    rows, lid = [], 0
    for b in range(300):
        for _ in range(rng.randint(1, 8)):
            lid += 1
            ev = 9 if b % 15 == 0 and rng.random() < 0.5 else rng.randint(1, 4)
            rows.append((lid, f"b{b}", ev))
    lines = spark.createDataFrame(rows, "line_id long, block_id string, event_id int")
    split = spark.createDataFrame(
        [(f"b{b}", "Anomaly" if b % 15 == 0 else "Normal", "train" if b < 240 else "test")
         for b in range(300)], "block_id string, label string, split string")
    counts = block_event_counts(block_events(lines))
    vocab = train_vocabulary(counts, split)
    names = [r[0] for r in vocab.orderBy("feature_index").select("feature_name").collect()]
    long = count_matrix_long(counts, split, vocab)
    wide = count_matrix_wide(long, split, names)
    vec = StageStore(spark, tmp_dir).materialize("v", lambda: sparse_counts(long, split, vocab),
                                                 schema=vector_schema())
    w = {r["block_id"]: [float(r[n]) for n in names] for r in wide.collect()}
    v = {r["block_id"]: r["features"].toArray().tolist() for r in vec.collect()}
    assert w == v
    m1 = train_random_forest(wide, names, numTrees=10)
    m2 = train_random_forest(vec, None, numTrees=10)
    p1 = predict_random_forest(m1, wide, names).orderBy("block_id").collect()
    p2 = predict_random_forest(m2, vec, None).orderBy("block_id").collect()
    assert p1 == p2
    nodes, psi = train_isolation_forest(spark, vec, None, n_trees=5)
    assert score_isolation_forest(spark, nodes, psi, vec, None).count() == 60


def test_distinct_row_scoring_is_exact(spark, wide):
    import numpy as np

    from blocklens.operators.iforest import _Forest
    nodes, psi = train_isolation_forest(spark, wide, NAMES, n_trees=20)
    forest = _Forest(nodes.toPandas(), psi)
    x = np.array([[r["E1"], r["E2"], r["E3"]] for r in wide.collect()], dtype=float)
    assert np.array_equal(forest.decision(x), forest._walk(x))


def test_a_vocabulary_of_thousands_has_one_form(spark, tmp_dir):
    """Wider than any limit there was: the same sparse path, and the forest trains on it."""
    from blocklens.operators.features import (block_event_counts, count_matrix_long,
                                              sparse_counts, train_vocabulary, vector_schema)
    from blocklens.plans.stages import StageStore
    lines = spark.range(12000).selectExpr("id AS line_id", "concat('b', id % 60) AS block_id",
                                          "cast(id % 3000 AS int) AS event_id")
    split = spark.createDataFrame([(f"b{b}", "Anomaly" if b % 6 == 0 else "Normal",
                                    "train" if b < 50 else "test") for b in range(60)],
                                  "block_id string, label string, split string")
    counts = block_event_counts(lines)
    vocab = train_vocabulary(counts, split)
    width = vocab.count()
    assert width > 2048
    vec = StageStore(spark, tmp_dir).materialize("v", lambda: sparse_counts(
        count_matrix_long(counts, split, vocab), split, vocab), schema=vector_schema())
    first = vec.first().features
    assert first.size == width and len(first.indices) == 50
    model = train_random_forest(vec, None, numTrees=3, maxDepth=4)
    assert predict_random_forest(model, vec, None).count() == 10
    nodes, psi = train_isolation_forest(spark, vec, None, n_trees=3)
    assert score_isolation_forest(spark, nodes, psi, vec, None).count() == 10


def test_sparse_scores_equal_dense_ones_and_equal_vectors_are_walked_once(spark):
    """The same forest and scores from entries as from dense rows."""
    rng = np.random.default_rng(4)
    dense = [(f"blk_{i}", "train" if i % 4 else "test", "Normal", rng.integers(0, 3, 12).astype(float).tolist())
             for i in range(300)]
    wide = spark.createDataFrame(
        [(b, s, lab, *x) for b, s, lab, x in dense],
        "block_id string, split string, label string, " + ", ".join(f"E{k} double" for k in range(12)))
    sparse = spark.createDataFrame(
        [(b, s, lab, (0, 12, [k for k, v in enumerate(x) if v], [v for v in x if v])) for b, s, lab, x in dense],
        "block_id string, split string, label string, "
        "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    names = [f"E{k}" for k in range(12)]
    a_nodes, a_psi = iforest.train_isolation_forest(spark, wide, names, n_trees=20, max_samples=64)
    b_nodes, b_psi = iforest.train_isolation_forest(spark, sparse, None, n_trees=20, max_samples=64)
    key = ["tree_id", "node_id"]
    assert a_psi == b_psi and a_nodes.orderBy(key).collect() == b_nodes.orderBy(key).collect()
    want = {r.block_id: r.score for r in iforest.score_isolation_forest(spark, a_nodes, a_psi, wide, names, None).collect()}
    got = {r.block_id: r.score for r in iforest.score_isolation_forest(spark, b_nodes, b_psi, sparse, None, None).collect()}
    assert got == want


def test_a_vocabulary_of_a_million_events(spark):
    """Rows stay sparse in training and scoring: dense ones would take 8 MB each."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        at = sorted(rng.choice(1_000_000, 6, replace=False).tolist()) if i % 3 else [5, 77, 999_999]
        rows.append((f"blk_{i}", "train", "Normal", (0, 1_000_000, at, [float(1 + i % 2)] * len(at))))
    sparse = spark.createDataFrame(
        rows, "block_id string, split string, label string, "
              "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    nodes, psi = iforest.train_isolation_forest(spark, sparse, None, n_trees=10)
    scores = {r.block_id: r.score for r in iforest.score_isolation_forest(
        spark, nodes, psi, sparse, None, None).collect()}
    assert len(scores) == 1500
    # a third of all blocks have one of two vectors and their scores
    assert len({round(scores[f"blk_{i}"], 12) for i in range(0, 1500, 3)}) <= 2


def test_random_forest_deals_many_rows_out(spark, wide, monkeypatch):
    """Training rows in one part are dealt to tasks of a bounded number of rows."""
    from pyspark.ml.classification import RandomForestClassifier
    fit, seen = RandomForestClassifier.fit, []
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: (
        seen.append([len(rows) for rows in data.rdd.glom().collect()]), fit(self, data))[1])
    model = train_random_forest(wide.coalesce(1), NAMES, numTrees=20, task_rows=100)
    assert sum(seen[0]) == 480 and len(seen[0]) >= 5 and max(seen[0]) < 200
    pred = predict_random_forest(model, wide, NAMES).toPandas()
    assert (pred["classification"] == pred["label"]).all()


def test_one_detector_is_scored_without_the_other(spark):
    from blocklens.plans.context import LogContext
    from blocklens.plans.stages import StageStore
    ctx = LogContext(spark, "/root/testdata/sf0.001")
    ctx.store = StageStore(spark, ctx.store.root + "-one-detector")
    assert ctx.iforest_predictions.count() > 0
    assert not ctx.store.exists("rf_model/metadata") and not ctx.store.exists("rf_predictions")
    assert set(ctx.detector_predictions) == {"isolation_forest", "random_forest"}
    assert ctx.store.exists("rf_model/metadata")
