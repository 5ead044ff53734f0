"""Small helpers shared by the operators: scratch tables, row sets, components."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blocklens.session import drop_written, scratch_path, ship_package

#: A set of ids is broadcast only while its measured row count stays below this
#: (16 bytes a row in the relation: 32 MB); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


#: rows of an Arrow batch: whole texts travel in them, on both sides of the pipe
BATCH_ROWS, BATCH_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with the package made importable on executors.

    Arrow batches are bounded to ``BATCH_ROWS`` rows where the session has
    Spark's default of 10,000, which are some 100 MB of texts a task; a setting
    of the user's own stays.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return spark


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty; every other column is ignored."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_frames(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInPandas`` that keeps whole numbers as they are beside a null.

    pandas has no null among its longs, so Spark hands over a long column with
    a null as doubles, which cannot hold ids above 2**53.  Here such a column
    arrives as nullable integers, and results are taken column by column.
    """
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def batches_of(batches):
        def frames():
            for batch in batches:
                yield pd.DataFrame({
                    field.name: column.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                    if column.null_count and pa.types.is_int64(field.type) else column.to_pandas()
                    for field, column in zip(batch.schema, batch.columns)})

        for frame in run(frames()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(frame[field.name], field.type, from_pandas=True) for field in target],
                schema=target)
    return df.mapInArrow(batches_of, schema)


_CACHES: dict[str, object] = {}


def own_caches(name: str, clear) -> None:
    """Called when a task of an operator begins: a Python worker that is used
    again lets go of what it holds for other operators (``clear`` drops ours)."""
    for other in [k for k in _CACHES if k != name]:
        _CACHES.pop(other)()
    _CACHES[name] = clear


#: Spark drops the shuffle files of a query when it ends, not when the driver's
#: garbage collection happens to meet it
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession):
    """Queries started within leave no shuffle files; the user's setting comes back."""
    before = spark.conf.get(CLEAN_SETTING, None)
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SETTING)
        else:
            spark.conf.set(CLEAN_SETTING, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage; the files outlive any executor.  Nothing reads the write's
    shuffles again, so they go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: of a staged frame
drop_stage = drop_written


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join with a staged frame of ids (null equals null).

    The ids are broadcast only below the measured bound; otherwise Spark
    shuffles both sides and splits skewed partitions.
    """
    ids = ids.select(F.col(key).alias("_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["_id"]), how)


def keep_rows(docs: DataFrame, verdicts: DataFrame, with_key) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, key, kept) keep, all columns.

    A doc_id that stands on one row is settled by its id alone, so no text is
    shuffled.  Ids on several rows are settled by id and key (``with_key`` adds
    the key as ``_key``), and equal (id, key) rows count as one.
    """
    per_id = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"),
                                            F.sum(F.col("kept").cast("int")).alias("stay"))
    several = stage(per_id.where("rows > 1").select("doc_id"), "several")
    gone = stage(per_id.where("rows > 1 or stay = 0").select("doc_id"), "gone")
    out = by_ids(docs, gone, "left_anti")
    if several.count():
        stay = by_ids(verdicts.where("kept"), several, "left_semi").select(
            F.col("doc_id").alias("_i"), F.col("key").alias("_k")).distinct()
        again = with_key(by_ids(docs, several, "left_semi")).dropDuplicates(["doc_id", "_key"])
        again = again.join(stay, again["doc_id"].eqNullSafe(stay["_i"])
                           & (again["_key"] == stay["_k"]), "left_semi")
        out = out.unionByName(again.select(docs.columns))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b longs).

    The component is its smallest node.  Alternates the large-star and
    small-star steps, which keep the edge count from growing and end after a
    logarithmic number of rounds.  Minima are pre-aggregated before they are
    shuffled, and each joined side is a staged table, so that Spark can split
    the partition of a hub.  Nothing is collected but two numbers a round.
    """
    live = stage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        now = live.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")), "cc-low")
        large = stage(both.where("v > u").join(low.hint("merge"), "u")
                      .select(F.col("v").alias("a"), F.col("m").alias("b")), "cc-large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least.hint("merge"), "a").where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        star = least.select("a", F.col("m").alias("b"))
        old, live = live, stage(small.union(star).distinct(), "cc")
        for table in (old, low, large, least):
            drop_stage(table)
    return live.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        live.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
