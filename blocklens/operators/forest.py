"""Supervised detector: random forest on event counts.

Spark ML's ``RandomForestClassifier`` trains distributed (per-node split
statistics are aggregated across partitions) and scores with a JVM-side
``transform``.  Class weights are the "balanced" weights of D4, attached with
a broadcast join of a one-row-per-class table.  Classes are indexed so that
Anomaly = 0: a probability tie then resolves to Anomaly, as with alphabetically
ordered class labels.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.operators.features import class_weights

SEED = 42
# Library-default forest: 100 trees, sqrt(features) per split, Gini, bootstrap.
# Spark's own ceiling for depth is 30.  ``maxBins`` bounds the split candidates of
# one feature: counts with up to that many distinct values split exactly, wider
# ones at that many quantiles (pass a larger value for exact splits there).
# Execution settings: bigger node batches mean fewer passes over the data;
# cached node ids (checkpointed every 10 iterations into the shared folder)
# keep deep trees from recomputing their path for every row.
RF_PARAMS = dict(numTrees=100, maxDepth=30, maxBins=256, featureSubsetStrategy="sqrt",
                 impurity="gini", bootstrap=True, minInstancesPerNode=1, seed=SEED,
                 maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
#: training rows of a task.  The fit caches a count and a node id per tree for each
#: row (about 1.4 KB with 100 trees) and reads both in every pass.
TASK_ROWS = 50_000


def assemble(wide: DataFrame, feature_names: list[str] | None) -> DataFrame:
    """Wide count columns -> one ``features`` vector (JVM-side).  With
    ``feature_names=None`` the frame already carries ``features`` (the sparse
    vector form of :func:`blocklens.operators.features.sparse_counts`)."""
    if feature_names is None:
        return wide
    va = VectorAssembler(inputCols=feature_names, outputCol="features", handleInvalid="keep")
    return va.transform(wide)


def _label_index(label: F.Column) -> F.Column:
    return F.when(label == "Anomaly", F.lit(0.0)).otherwise(F.lit(1.0))


def train_random_forest(wide: DataFrame, feature_names: list[str] | None,
                        split: str = "train", task_rows: int = TASK_ROWS,
                        **overrides) -> RandomForestClassificationModel:
    """D3: fit on the training split (Normal and Anomaly) with D4 weights, in tasks of
    about ``task_rows`` rows at most."""
    part = wide.where(F.col("split") == split)
    weights = class_weights(wide.select("block_id", "split", "label"), split)
    data = assemble(part, feature_names) \
        .join(F.broadcast(weights.select("label", "weight")), "label") \
        .withColumn("label_idx", _label_index(F.col("label")))
    parts = -(-part.count() // task_rows)
    if parts > 1:       # by key, so that a task run again gets the same rows
        data = data.repartition(max(parts, part.rdd.getNumPartitions()), "block_id")
    params = dict(RF_PARAMS)
    params.update(overrides)
    rf = RandomForestClassifier(labelCol="label_idx", featuresCol="features",
                                weightCol="weight", **params)
    return rf.fit(data.select("features", "label_idx", "weight"))


def predict_random_forest(model: RandomForestClassificationModel, wide: DataFrame,
                          feature_names: list[str], split: str | None = "test") -> DataFrame:
    """``(block_id, anomaly_probability, classification, label)``."""
    part = wide if split is None else wide.where(F.col("split") == split)
    # only P(Anomaly) and the class are needed: skip the raw-prediction column
    scorer = model.copy()
    scorer.setRawPredictionCol("")
    scored = scorer.transform(assemble(part, feature_names))
    return scored.select(
        "block_id",
        vector_to_array("probability")[0].alias("anomaly_probability"),
        F.when(F.col("prediction") == 0.0, F.lit("Anomaly")).otherwise(F.lit("Normal"))
        .alias("classification"),
        "label",
    )


def feature_importances(spark: SparkSession, model: RandomForestClassificationModel,
                        feature_names: list[str] | None, top: int | None = 10,
                        vocabulary: DataFrame | None = None) -> DataFrame:
    """Importances by feature name, highest first.  The importance vector
    is part of the model (on the driver, one value per feature); names come
    from ``feature_names`` or, for the sparse form, from ``vocabulary``."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(enumerate(imp, start=1), key=lambda r: (-r[1], r[0]))
    if top is not None:
        rows = rows[:top]
    ranked = spark.createDataFrame(
        [(i + 1, idx, float(v)) for i, (idx, v) in enumerate(rows)],
        "rank int, feature_index int, importance double")
    if feature_names is not None:
        names = spark.createDataFrame(list(enumerate(feature_names, start=1)),
                                      "feature_index int, feature_name string")
    else:
        names = vocabulary.select("feature_index", "feature_name")
    return ranked.join(names, "feature_index").select("rank", "feature_name", "importance")


def describe_trees(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """Per-tree size summary of a fitted forest."""
    rows = [(i, t.numNodes, t.depth) for i, t in enumerate(model.trees)]
    return spark.createDataFrame(rows, "tree_id int, n_nodes int, depth int")


def stored_forest(store, name: str, vectors: DataFrame) -> RandomForestClassificationModel:
    """The forest saved in ``store`` under ``name``, fitted first if it is not there."""
    path = store.path(name)
    if not store.exists(name + "/metadata") or not store.exists(name + "/treesMetadata"):
        train_random_forest(vectors, None).write().overwrite().save(path)
    return RandomForestClassificationModel.load(path)
