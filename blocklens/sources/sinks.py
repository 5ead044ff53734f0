"""Sinks: overwrite, write-once, append-with-resume, alert JSON, CSV export.

All writes are distributed (one file per task) into a folder; nothing is
gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.plans.stages import _fs_exists, is_complete


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the output."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_once(df: DataFrame, path: str, *others: str) -> None:
    """Refuse when the output -- or any sibling output written together
    with it -- already exists."""
    spark = df.sparkSession
    for p in (path, *others):
        if is_complete(spark, p):
            raise FileExistsError(f"{p} already exists; it is written only once")
    df.write.mode("overwrite").parquet(path)


def remaining_work(todo: DataFrame, done: DataFrame, key: str = "block_id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (anti-join)."""
    return todo.join(done.select(key), key, "left_anti")


def append_resumable(spark: SparkSession, todo: DataFrame, path: str, compute,
                     key: str = "block_id", chunks: int = 1) -> DataFrame:
    """Compute only the keys not yet in ``path`` and append them.

    ``compute(remaining) -> DataFrame`` produces output rows.  The remaining
    keys are cut into ``chunks`` hash buckets, each appended by its own job;
    a job's files become visible atomically, so an aborted run keeps every
    finished chunk and a rerun resumes with the rest (executor loss inside a
    chunk is handled by task retry).
    """
    remaining = todo
    if _fs_exists(spark, path):
        remaining = remaining_work(todo, spark.read.parquet(path), key)
    if chunks <= 1:
        compute(remaining).write.mode("append").parquet(path)
    else:       # the work list is made once, and each chunk reads its own folder of it
        from blocklens.session import scratch_path
        listed = scratch_path(spark, "remaining")
        remaining.withColumn("_chunk", F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int")) \
            .write.partitionBy("_chunk").parquet(listed)
        rows = spark.read.schema(remaining.schema.add("_chunk", "integer")).parquet(listed)
        for c in range(chunks):
            compute(rows.where(F.col("_chunk") == c).drop("_chunk")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_alerts_json(alerts: DataFrame, path: str) -> None:
    """JSON Lines, NULL fields written out, non-ASCII kept."""
    alerts.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted multi-line text (read back with ``multiLine``)."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def read_csv_export(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = (spark.read.option("header", True).option("multiLine", True)
         .option("quote", '"').option("escape", '"'))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)
