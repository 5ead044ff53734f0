"""Stage outputs written once to the shared folder.

A stage is a DataFrame that later stages read several times (parsed lines,
templates, sequences, split ids, ...).  It is written as Parquet below a root
in ``spark.checkpoint.dir`` and read back, which

* cuts the lineage (small plans, no recomputation of regex chains),
* survives executor loss (the files live in the shared folder),
* keeps Catalyst's column pruning and filter pushdown on re-reads,
* makes a run restartable: a stage whose ``_SUCCESS`` marker exists is read,
  not recomputed (phase checkpointing).
"""

from __future__ import annotations

import hashlib
import os
import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blocklens.session import shared_root


_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.Lock:
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def is_complete(spark: SparkSession, path: str) -> bool:
    return _fs_exists(spark, path.rstrip("/") + "/_SUCCESS")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files below ``path``."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return "missing"
    files, found = fs.listFiles(jpath, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


class StageStore:
    """Parquet stages under one root (one root per input + settings)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    @classmethod
    def for_inputs(cls, spark: SparkSession, version: str, *inputs: str) -> "StageStore":
        """A store named by its input folders and the state of their files, so a
        restarted application finds its stages and changed inputs get new ones."""
        key = "|".join([version, *(f"{p}:{fingerprint(spark, p)}" for p in inputs)])
        tag = hashlib.sha1(key.encode()).hexdigest()[:16]
        return cls(spark, os.path.join(shared_root(spark), "stages", tag))

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def exists(self, name: str) -> bool:
        return is_complete(self.spark, self.path(name))

    def materialize(self, name: str, build, partition_by: list[str] | None = None,
                    schema=None) -> DataFrame:
        """Read stage ``name`` if complete, else build, write and read it (with
        ``schema`` when its types are not those of the files)."""
        p = self.path(name)
        with _lock_for(p):     # queries running in threads share one stage
            if not is_complete(self.spark, p):
                df = build()
                w = df.write.mode("overwrite")
                if partition_by:
                    w = w.partitionBy(*partition_by)
                w.parquet(p)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(p)

    def observed(self, name: str, build, figures: list) -> tuple[DataFrame, DataFrame]:
        """Stage ``name`` and a row of ``figures`` (whole-number aggregates of its
        rows), observed by the pass that writes it; the row completes the stage."""
        p, side = self.path(name), self.path(name + "_figures")
        with _lock_for(p):
            if not is_complete(self.spark, side):
                seen = Observation(name)
                build().observe(seen, *figures).write.mode("overwrite").parquet(p)
                row = seen.get
                self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row)) \
                    .coalesce(1).write.mode("overwrite").parquet(side)
        return self.spark.read.parquet(p), self.spark.read.parquet(side)

    def timed(self, name: str, build) -> DataFrame:
        """Stage ``name`` of scored rows with ``inference_time_sec`` per row.

        The rows are written once; the time of that job and the rows it counted
        stand in a side table, which completes the stage, so a run that dies in
        between scores (and times) again.
        """
        p, side = self.path(name), self.path(name + "_time")
        with _lock_for(p):
            if not is_complete(self.spark, side):
                seen = Observation(name)
                began = time.perf_counter()
                build().observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(p)
                spent = time.perf_counter() - began
                self.spark.createDataFrame([(spent / max(1, seen.get["n"]),)], "seconds double") \
                    .coalesce(1).write.mode("overwrite").parquet(side)
        return self.read_timed(name)

    def read_timed(self, name: str) -> DataFrame | None:
        """The rows of a complete :meth:`timed` stage with their time; else None."""
        if not self.exists(name + "_time"):
            return None
        seconds = self.spark.read.parquet(self.path(name + "_time")).first()["seconds"]
        return self.spark.read.parquet(self.path(name)).withColumn("inference_time_sec", F.lit(seconds))

    def bucketed(self, name: str, build, key: str = "block_id", buckets: int | None = None) -> DataFrame:
        """Stage ``name`` dealt into ``buckets`` by ``key`` (default: as many as
        shuffle partitions) and sorted by it.

        Spark knows the layout, so joins and groupings by ``key`` among stages of
        equally many buckets need no shuffle, and a filter on one key reads one
        bucket.  The table is registered for the session; a later session
        registers the files that are there.
        """
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        p = self.path(f"{name}_in_{n}")
        table = "stage_" + hashlib.sha1(p.encode()).hexdigest()[:20]
        with _lock_for(p):
            if not is_complete(self.spark, p):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                build().repartition(n, key).write.mode("overwrite").option("path", p).format("parquet") \
                    .bucketBy(n, key).sortBy(key).saveAsTable(table)
            elif not self.spark.catalog.tableExists(table):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                                    for f in self.spark.read.parquet(p).schema)
                self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) "
                               f"SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{p}'")
        return self.spark.table(table)

    def write_once(self, name: str, df: DataFrame) -> DataFrame:
        """Refuse to replace a complete stage; what a write that died has
        left is no stage and is written over."""
        p = self.path(name)
        if is_complete(self.spark, p):
            raise FileExistsError(f"{p} already exists; it is written only once")
        df.write.mode("overwrite").parquet(p)
        return self.spark.read.parquet(p)
