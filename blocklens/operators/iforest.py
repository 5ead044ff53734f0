"""Unsupervised detector: isolation forest.

Spark ML has no isolation forest, so it is expressed as Spark jobs:

* **sample** -- per tree, the psi rows with the smallest seeded hash key
  (:func:`sample_per_tree`): a uniform sample without replacement, found with
  a map-side filter and a per-tree top-k -- no global sort, no N x T rows written.
* **grow** -- ``groupBy(tree_id).applyInPandas``: one task per tree, psi rows
  each (bounded), RNG seeded by (seed, tree_id) and rows sorted by index first
  so the tree does not depend on shuffle order.  Splits pick a random
  non-constant feature and a uniform threshold in [min, max).
* **score** -- the model is a node table (at most T x (2 psi - 1) rows); it is
  broadcast once as NumPy arrays and a ``pandas_udf`` walks all trees for an
  Arrow batch of rows at a time.  Sparse count vectors are grouped first, so a
  vector is walked once however many blocks have it, and stay sparse: a tree
  sees only the columns that it splits by.

Score s(x) = 2 ** (-E[h(x)] / c(psi)); decision = 0.5 - s (lower = more
anomalous); Anomaly iff decision < 0.  Liu, Ting & Zhou (ICDM 2008).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
N_TREES = 100
MAX_SAMPLES = 256
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, "
               "right int, leaf_value double, depth int, n_samples int")


def average_path_length(n):
    """c(n): expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def compressed(indices, values, features: np.ndarray) -> np.ndarray:
    """The columns ``features`` (sorted) of rows given by their entries, dense."""
    sizes = [len(i) for i in indices]
    x = np.zeros((len(sizes), len(features)))
    if sum(sizes) and len(features):
        flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in indices])
        at = np.minimum(np.searchsorted(features, flat), len(features) - 1)
        own = features[at] == flat
        row = np.repeat(np.arange(len(sizes)), sizes)
        x[row[own], at[own]] = np.concatenate([np.asarray(v, dtype=float) for v in values])[own]
    return x


def _grow(max_depth: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_idx", "block_id"], kind="mergesort")
        tree_id = int(pdf["tree_id"].iloc[0])
        if "indices" in pdf:        # only features that some row of the sample has can split it
            used = np.unique(np.concatenate([np.asarray(i, dtype=np.int64) for i in pdf["indices"]]))
            x = compressed(pdf["indices"], pdf["values"], used)
        else:
            x = np.vstack(pdf["features"].to_numpy()).astype(float)
            used = np.arange(x.shape[1])
        rng = np.random.default_rng([seed, tree_id])
        nodes = []   # node_id, feature, threshold, left, right, leaf_value, depth, n

        def build(idx, depth):
            node_id = len(nodes)
            nodes.append(None)
            sub = x[idx]
            if len(idx) <= 1 or depth >= max_depth:
                nodes[node_id] = (node_id, -1, 0.0, -1, -1,
                                  depth + float(average_path_length([len(idx)])[0]),
                                  depth, len(idx))
                return node_id
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            candidates = np.flatnonzero(hi > lo)
            if len(candidates) == 0:
                nodes[node_id] = (node_id, -1, 0.0, -1, -1,
                                  depth + float(average_path_length([len(idx)])[0]),
                                  depth, len(idx))
                return node_id
            f = int(rng.choice(candidates))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] <= thr
            left = build(idx[go_left], depth + 1)
            right = build(idx[~go_left], depth + 1)
            nodes[node_id] = (node_id, int(used[f]), thr, left, right, 0.0, depth, len(idx))
            return node_id

        build(np.arange(len(x)), 0)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left", "right",
                                           "leaf_value", "depth", "n_samples"])
        out.insert(0, "tree_id", tree_id)
        return out
    return grow


def features_array(wide: DataFrame, feature_names: list[str] | None) -> F.Column:
    """Per-row feature values: wide count columns, or (``feature_names=None``)
    the ``features`` vector of the sparse form."""
    if feature_names is None:
        from pyspark.ml.functions import vector_to_array
        return vector_to_array(F.col("features"))
    return F.array(*[F.col(f"`{n}`").cast("double") for n in feature_names])


def is_sparse(rows: DataFrame) -> bool:
    """Whether ``features`` has the layout of a sparse vector (indices, values)."""
    field = rows.schema["features"].dataType if "features" in rows.columns else None
    return isinstance(field, T.StructType)


def sample_per_tree(rows: DataFrame, n_rows: int, n_trees: int, psi: int, seed: int,
                    key: str = "block_id", oversample: float = 4.0) -> DataFrame:
    """Exactly ``psi`` distinct rows per tree, uniformly without replacement.

    Every (tree, row) pair gets a seeded hash key u in [0, 1); a tree's sample
    is its ``psi`` rows with the smallest keys.  Only pairs with
    u < rate (about ``oversample * psi`` per tree) are materialised -- the pairs
    pass a map-side filter in the same generated loop, no global sort -- and the
    per-tree rank filter runs as a top-k before its shuffle.  A tree left with fewer than
    ``psi`` candidates is redrawn with a doubled rate, so the result is exact.
    """
    rate = min(1.0, oversample * psi / max(n_rows, 1))
    while True:
        pairs = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"))
        u = F.pmod(F.xxhash64(F.lit(seed), F.col("tree_id"), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        exploded = pairs.withColumn("u", u).where(F.col("u") < F.lit(rate))
        w = Window.partitionBy("tree_id").orderBy("u", key)
        picked = exploded.withColumn("_rk", F.row_number().over(w)) \
            .where(F.col("_rk") <= psi).drop("_rk")
        if rate >= 1.0:
            return picked
        # trees with enough candidates: a partial count, one row per tree
        n_ok = exploded.groupBy("tree_id").count().where(F.col("count") >= psi).count()
        if n_ok == n_trees:
            return picked
        rate = min(1.0, rate * 2)


def train_isolation_forest(spark: SparkSession, wide: DataFrame, feature_names: list[str],
                           n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                           seed: int = SEED, split: str = "train") -> tuple[DataFrame, int]:
    """Fit on the Normal rows of the training split only (P5).

    Returns ``(nodes, psi)``; ``nodes`` has one row per tree node.
    """
    from blocklens.session import ship_package
    ship_package(spark)
    values = (F.col("features.indices"), F.col("features.values")) if is_sparse(wide) else (
        features_array(wide, feature_names).alias("features"),)
    normal = wide.where((F.col("split") == split) & (F.col("label") == "Normal")).select("block_id", *values)
    n = normal.count()                      # one number (partial count)
    psi = int(min(max_samples, n))
    if psi < 1:
        raise ValueError("no Normal training rows to fit the isolation forest")
    sampled = sample_per_tree(normal, n, n_trees, psi, seed) \
        .withColumnRenamed("u", "row_idx")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = sampled.groupBy("tree_id").applyInPandas(
        _grow(max_depth, seed), schema=NODE_SCHEMA)
    return nodes, psi


class _Forest:
    """Node arrays of all trees, padded to the widest tree."""

    def __init__(self, nodes_pdf: pd.DataFrame, psi: int):
        trees = sorted(nodes_pdf["tree_id"].unique())
        width = int(nodes_pdf.groupby("tree_id").size().max())
        shape = (len(trees), width)
        self.feature = np.full(shape, -1, dtype=np.int64)
        self.threshold = np.zeros(shape)
        self.left = np.full(shape, -1, dtype=np.int64)
        self.right = np.full(shape, -1, dtype=np.int64)
        self.value = np.zeros(shape)
        for ti, t in enumerate(trees):
            g = nodes_pdf[nodes_pdf["tree_id"] == t]
            ids = g["node_id"].to_numpy()
            self.feature[ti, ids] = g["feature"].to_numpy()
            self.threshold[ti, ids] = g["threshold"].to_numpy()
            self.left[ti, ids] = g["left"].to_numpy()
            self.right[ti, ids] = g["right"].to_numpy()
            self.value[ti, ids] = g["leaf_value"].to_numpy()
        self.c_psi = float(average_path_length([psi])[0]) or 1.0

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Decision scores of the rows of ``x``.  Count vectors repeat a lot,
        so only the distinct rows of the batch are walked (exact: equal rows
        get equal scores); each tree is walked level by level over the rows
        still at an inner node."""
        if len(x) == 0:
            return np.zeros(0)
        uniq, inverse = np.unique(x, axis=0, return_inverse=True)
        return self._walk(uniq)[inverse.reshape(-1)]

    def decision_of_entries(self, indices, values) -> np.ndarray:
        """Decision scores of rows given by their entries, at any width: a tree
        sees only the columns that it splits by (at most psi - 1)."""
        n = len(indices)
        total = np.zeros(n)
        for ti in range(self.feature.shape[0]):
            used = np.unique(self.feature[ti][self.feature[ti] >= 0])
            column = np.where(self.feature[ti] >= 0, np.searchsorted(used, self.feature[ti]), -1)
            total += self._leaf_values(ti, compressed(indices, values, used), column)
        return self._score(total)

    def _walk(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for ti in range(self.feature.shape[0]):
            total += self._leaf_values(ti, x, self.feature[ti])
        return self._score(total)

    def _leaf_values(self, ti: int, x: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Where the rows of ``x`` end in tree ``ti``; ``feature`` names x's columns."""
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[node]
            active = f >= 0
            if not active.any():
                return self.value[ti, node]
            xa = x[rows[active], f[active]]
            go_left = xa <= self.threshold[ti, node[active]]
            node[active] = np.where(go_left, self.left[ti, node[active]],
                                    self.right[ti, node[active]])

    def _score(self, total: np.ndarray) -> np.ndarray:
        mean_h = total / self.feature.shape[0]
        return 0.5 - np.power(2.0, -mean_h / self.c_psi)


def forest_scorer(spark: SparkSession, nodes: DataFrame, psi: int):
    """``features array<double> -> decision score``; the trees are broadcast once,
    and every use of the returned function shares them."""
    from blocklens.session import ship_package
    ship_package(spark)                 # workers unpickle the model class
    nodes_pdf = nodes.toPandas()      # bounded: <= T x (2 psi - 1) rows
    bc = spark.sparkContext.broadcast(_Forest(nodes_pdf, psi))

    @F.pandas_udf(T.DoubleType())
    def decision(features: pd.Series) -> pd.Series:
        x = np.vstack(features.to_numpy()).astype(float) if len(features) else \
            np.zeros((0, 1))
        return pd.Series(bc.value.decision(x))
    return decision


def entry_scorer(spark: SparkSession, nodes: DataFrame, psi: int):
    """``(indices array<int>, values array<double>) -> decision score``."""
    from blocklens.session import ship_package
    ship_package(spark)
    bc = spark.sparkContext.broadcast(_Forest(nodes.toPandas(), psi))       # bounded, as above

    @F.pandas_udf(T.DoubleType())
    def decision(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(bc.value.decision_of_entries(indices.tolist(), values.tolist()))
    return decision


def class_of_score(score: F.Column) -> F.Column:
    return F.when(score < 0, F.lit("Anomaly")).otherwise(F.lit("Normal"))


def score_isolation_forest(spark: SparkSession, nodes: DataFrame, psi: int, wide: DataFrame,
                           feature_names: list[str] | None, split: str | None = "test") -> DataFrame:
    """``(block_id, score, classification, label)``; score = decision."""
    part = wide if split is None else wide.where(F.col("split") == split)
    if is_sparse(wide):
        # equal vectors are one row before any tree is walked: blocks are many, vectors few
        entries = ["features.indices", "features.values"]
        rows = part.select("block_id", "label", *entries)
        distinct = rows.select("indices", "values").distinct()
        scores = distinct.withColumn("score", entry_scorer(spark, nodes, psi)("indices", "values"))
        scored = rows.join(scores, ["indices", "values"]).select("block_id", "label", "score")
    else:
        decision = forest_scorer(spark, nodes, psi)
        scored = part.select("block_id", "label",
                             decision(features_array(wide, feature_names)).alias("score"))
    return scored.select("block_id", "score", class_of_score(F.col("score")).alias("classification"),
                         "label")


def stored_isolation_forest(store, name: str, vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(nodes, psi)`` saved in ``store`` under ``name``, trained first if they are
    not there; psi stands beside the nodes."""
    def build():
        nodes, psi = train_isolation_forest(store.spark, vectors, None)
        return nodes.withColumn("psi", F.lit(psi))
    saved = store.materialize(name, build)
    return saved.drop("psi"), saved.select("psi").first()[0]
