"""Event-count features (G3, G4) and class weights.

Counts come from the long form ``(block_id, event_id)`` with a partial
aggregation, so a block with millions of lines never becomes one array.
The vocabulary is the set of event ids seen in *training* blocks, ordered as
strings ("1" < "10" < "2"), feature names ``E<id>``; test events outside it
are ignored and absent counts are 0.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocklens.operators.ordinals import dense_ordinal

FEATURE_PREFIX = "E"


def block_event_counts(block_events: DataFrame) -> DataFrame:
    """``(block_id, event_id, n)``: the per-line table reduced by a partial
    aggregation -- every later feature step starts from this, not the lines."""
    return block_events.groupBy("block_id", "event_id").agg(F.count(F.lit(1)).alias("n"))


def train_vocabulary(counts: DataFrame, split_ids: DataFrame) -> DataFrame:
    """``(feature_index, event_id, feature_name)``, 1-based, string order.

    ``counts`` is :func:`block_event_counts` (or the per-line table)."""
    train = split_ids.where(F.col("split") == "train").select("block_id")
    ids = counts.join(train, "block_id", "left_semi").select("event_id").distinct()
    keyed = ids.withColumn("_key", F.col("event_id").cast("string"))
    ranked = dense_ordinal(keyed, ["_key"], "feature_index")
    return ranked.select(
        F.col("feature_index").cast("int"), "event_id",
        F.concat(F.lit(FEATURE_PREFIX), F.col("_key")).alias("feature_name"))


def count_matrix_long(counts: DataFrame, split_ids: DataFrame,
                      vocabulary: DataFrame) -> DataFrame:
    """G3 long form: ``(block_id, split, label, feature_index, feature_name, n)``
    with n > 0, vocabulary events only.  ``counts`` is
    :func:`block_event_counts`.  The vocabulary (one row per template) is
    broadcast by AQE from its measured size, not by a hint."""
    keyed = counts.join(split_ids.select("block_id", "split", "label"), "block_id")
    return keyed.join(vocabulary, "event_id").select(
        "block_id", "split", "label", "feature_index", "feature_name", "n")


def sparse_counts(long_counts: DataFrame, split_ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """G3 for the detectors, at any width: ``(block_id, split, label, features)``.

    ``features`` has the layout of a sparse ML vector (type, size, indices,
    values), built from the counts; written as Parquet and read with
    :func:`vector_schema` it is one, with no Python in between.  Every block of
    ``split_ids`` appears.  A block's entries are its distinct events.
    """
    width = vocabulary.agg(F.count(F.lit(1)).cast("int").alias("width"))
    entry = F.struct((F.col("feature_index") - 1).alias("i"), F.col("n").cast("double").alias("v"))
    own = long_counts.groupBy("block_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    full = split_ids.select("block_id", "split", "label").join(own, "block_id", "left") \
        .crossJoin(F.broadcast(width))                          # one row
    entries = F.coalesce("e", F.array().cast("array<struct<i:int,v:double>>"))
    return full.select("block_id", "split", "label", F.struct(
        F.lit(0).cast("byte").alias("type"), F.col("width").alias("size"),
        F.transform(entries, lambda x: x["i"]).alias("indices"),
        F.transform(entries, lambda x: x["v"]).alias("values")).alias("features"))


def vector_schema() -> T.StructType:
    return T.StructType([T.StructField("block_id", T.StringType()), T.StructField("split", T.StringType()),
                         T.StructField("label", T.StringType()),
                         T.StructField("features", VectorUDT())])


def count_matrix_wide(long_counts: DataFrame, split_ids: DataFrame,
                      names: list[str]) -> DataFrame:
    """G3 wide form, an export: ``block_id, split, label`` and one column for each
    of ``names`` (0 where absent).  Every block of ``split_ids`` appears.  A count
    of a feature that is not among ``names`` fails the job."""
    short = F.raise_error(F.concat(F.lit("the export has no column for "), "feature_name"))
    named = F.when(F.col("feature_name").isin(*names), F.col("feature_name")).otherwise(short.cast("string"))
    wide = long_counts.withColumn("feature_name", named).groupBy("block_id").pivot("feature_name", names).agg(F.sum("n"))
    full = split_ids.select("block_id", "split", "label").join(wide, "block_id", "left")
    return full.select("block_id", "split", "label",
                       *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias(n)
                         for n in names])


def class_weights(split_ids: DataFrame, split: str = "train") -> DataFrame:
    """D4 "balanced" weights: n / (k * n_c) per class of the training split."""
    part = split_ids.where(F.col("split") == split)
    counts = part.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0))
    return counts.select(
        "label", "n_c",
        (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))
